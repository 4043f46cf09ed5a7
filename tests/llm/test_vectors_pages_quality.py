import re
import base64
import hashlib
import random
import zlib

import numpy as np
import pytest
from helpers import docs, prose, roots
from pyspark.sql import functions as F

from ledgerwatch.llm import components, embedding_dedup, html_extract, maxscore, quality_crf, warc

VECTORS = "vec_id long, embedding array<float>, label int"
NAN = float("nan")


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in rows], VECTORS)


def test_components(spark):
    pairs = [(5, 4), (4, 3), (3, 9), (10, 11), (11, 10), (7, 7)] + [(100 + i, 101 + i) for i in range(60)]
    want = roots({x for p in pairs for x in p if p != (7, 7)}, [p for p in pairs if p != (7, 7)])
    found = components.connected(spark.createDataFrame(pairs, "a long, b long"))
    assert {r.node: r.component for r in found.collect()} == want
    assert components.connected(spark.createDataFrame([], "a long, b long")).collect() == []


def near_by_definition(rows, least=0.9):
    usable = {i: np.array(v, np.float64) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    unit = {i: v / np.linalg.norm(v) for i, v in usable.items()}
    linked = [(a, b) for a in unit for b in unit if a < b and unit[a] @ unit[b] >= least]
    root = roots([i for i, _ in rows], linked)
    count = {i: sum(i in p for p in linked) for i, _ in rows}
    return {i: (count[i], root[i], root[i] == i) for i, _ in rows}


def test_near_vectors_by_definition(spark):
    rng = np.random.default_rng(1)
    x = np.float32(rng.normal(size=(300, 16)))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000 + i, np.float32(x[0] + rng.normal(size=16) * 0.1).tolist()) for i in range(60)]
    rows += [(2000 + i, x[1].tolist()) for i in range(30)] + [(3000 + i, np.float32(x[2 + i] * 1.7).tolist()) for i in range(20)]
    rows += [(5000, None), (5001, [0.0] * 16), (5002, [NAN] + [1.0] * 15), (5003, [None] + [1.0] * 15), (5004, []), (5005, [float("inf")] * 16)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_vectors(vectors(spark, rows)).collect()}
    assert got == near_by_definition(rows)


def test_bridges_between_dense_groups(spark):
    """Two groups of 249 near copies, joined by one link: its ends have far more links than any list holds."""
    rng = np.random.default_rng(3)
    one, two = np.eye(32)[:2]
    turned = lambda angle: np.cos(angle) * one + np.sin(angle) * two
    noise = lambda: np.concatenate([np.zeros(2), rng.normal(size=30)]) * 0.01
    x = [turned(-0.4) + noise() for _ in range(249)] + [turned(0.4) + noise() for _ in range(249)] + [turned(-0.2), turned(0.2)]
    rows = [(i, np.float32(v).tolist()) for i, v in enumerate(x)]
    want = near_by_definition(rows)
    assert {c for _, c, _ in want.values()} == {0}
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_vectors(vectors(spark, rows), most=1).collect()}
    assert got == want


def test_rare_links_beside_a_dense_group(spark, monkeypatch):
    """Isolated pairs that the search cannot meet are found by the audit, whatever a dense group adds to its links."""
    monkeypatch.setattr(embedding_dedup, "starting_pairs", lambda nodes, *_: nodes.select(
        F.col("node").alias("a"), F.lit(0).cast("bigint").alias("b"), F.lit(0.95).alias("sim")).where("a between 1 and 39"))
    monkeypatch.setattr(embedding_dedup, "AUDITED", 32)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(301, 48))
    x[1:40] = x[0] + rng.normal(size=(39, 48)) * 0.02
    rows = [(i, np.float32(v).tolist()) for i, v in enumerate(x)] + [(1000 + i, np.float32(x[i] * 1.5 + 0.01).tolist()) for i in range(290, 301)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_vectors(vectors(spark, rows), rounds=0, most=1).collect()}
    assert got == near_by_definition(rows)


def test_partitions_follow_the_number_of_rows():
    few, many = (embedding_dedup.partitions(n, 0.9, 0.98) for n in (5_000, 10_000_000))
    assert few == 7 and many > 40


def test_near_vectors_of_small_tables(spark):
    empty = vectors(spark, [(1, None)])
    assert embedding_dedup.near_vectors(empty.where("false")).collect() == []
    assert [tuple(r) for r in embedding_dedup.near_vectors(empty).collect()] == [(1, 0, 1, True)]


@pytest.mark.parametrize("block, batch", [(256, 16), (2, 2)])
def test_top_vectors_by_definition(spark, monkeypatch, block, batch):
    monkeypatch.setattr(maxscore, "SHARD", 20)
    monkeypatch.setattr(maxscore, "TURN", 2)
    monkeypatch.setattr(maxscore, "BLOCK", block)
    monkeypatch.setattr(maxscore, "BATCH", batch)
    rng = np.random.default_rng(2)
    x = np.float32(rng.normal(size=(400, 12)) * rng.choice([0.1, 1], size=(400, 1)))
    x[50:60] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1050, [NAN] * 12), (1100, [1.0, 2.0])]
    got = sorted(tuple(r) for r in maxscore.search(vectors(spark, rows), F.col("vec_id") % 50 == 0).collect())
    cells = {i: np.floor(256 * np.pad(np.array(v, np.float64), (0, 12 - len(v)))).astype(int) for i, v in rows if v and not np.isnan(v[0])}
    want = []
    for q in (i for i in cells if i % 50 == 0):
        best = sorted(((-int(cells[q] @ c), i) for i, c in cells.items() if i != q))[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want)


def test_top_vectors_of_many_tasks(spark, monkeypatch):
    """Every batch of queries meets every turn of shards, also where these lie in several partitions; ids may be narrow integers."""
    for name, value in (("SHARD", 20), ("TURN", 2), ("BLOCK", 4), ("BATCH", 2)):
        monkeypatch.setattr(maxscore, name, value)
    x = np.float32(np.random.default_rng(8).normal(size=(600, 12)))
    cells = np.floor(256 * x.astype(np.float64)).astype(np.int64)
    want = []
    for q in range(0, 600, 50):
        best = sorted((-int(s), i) for i, s in enumerate(cells @ cells[q]) if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    table = vectors(spark, list(enumerate(x.tolist())))
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(coalesce, "true")
    spark.conf.set(coalesce, "false")
    try:
        for ids in ("bigint", "int"):
            found = maxscore.search(table.withColumn("vec_id", F.col("vec_id").cast(ids)), F.col("vec_id") % 50 == 0)
            assert found.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
            assert sorted(tuple(r) for r in found.collect()) == want, ids
    finally:
        spark.conf.set(coalesce, before)


def test_top_vectors_of_large_components(spark):
    """Products beyond 2^53 and cells beyond 32 bits are exact; a score beyond 64 bits is an error."""
    asks = F.col("vec_id") % 50 == 0
    rows = [(50, [1.0, 0.0, 3.0]), (51, [1e7, 0.0, -1.0]), (52, [-1e7, 5.0, 0.0]), (53, [1e7, 0.0, -1.0 + 1 / 256]), (100, [1e7, 1e7, 1.0])]
    cells = {i: [int(np.floor(256 * v)) for v in x] for i, x in rows}
    want = []
    for q in (50, 100):
        best = sorted((-sum(a * b for a, b in zip(cells[q], c)), i) for i, c in cells.items() if i != q)
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted(tuple(r) for r in maxscore.search(vectors(spark, rows), asks).collect()) == want
    with pytest.raises(Exception, match="OverflowError|too large|out of bounds|too big"):
        maxscore.search(vectors(spark, [(50, [1e15]), (51, [1e15])]), asks).collect()


def test_top_vectors_of_repeated_ids_and_clashing_columns(spark):
    asks = F.col("vec_id") % 50 == 0
    table = vectors(spark, [(50, [1.0]), (50, [1.0]), (51, [2.0]), (51, [2.0])]).withColumns({c: F.lit("mine") for c in ("id", "rank", "turn", "score")})
    found = [tuple(r) for r in maxscore.search(table, asks).collect()]
    assert {r[:3] for r in found} == {(50, 1, 51), (50, 2, 51)} or {r[:3] for r in found} == {(50, 1, 51)}


def test_top_vectors_of_small_tables(spark):
    one = vectors(spark, [(50, [1.0])])
    asks = F.col("vec_id") % 50 == 0
    assert maxscore.search(one, asks).collect() == [] and maxscore.search(one.where("false"), asks).collect() == []
    two = vectors(spark, [(50, [1.0]), (51, [-1.0])])
    assert [tuple(r) for r in maxscore.search(two, asks).collect()] == [(50, 1, 51, -65536)]


PAGES = "page_id long, url string, html string"


def test_archives_round_trip(spark):
    html = ["x", "x", None, "", "é\r\n\r\nWARC/1.1", "y" * 5000, "x"]
    urls = ["http://A.com/", "http://a.com", None, None, "https://b.org:8080/p?q", "http://[bad", "http://a.com/"]
    rows = list(zip([4, 1, 2, 3, 5, 6, 7], urls, html)) + [(10 + i, "http://hot.net/", f"{i % 3}") for i in range(1500)]
    found = warc.archive(spark.createDataFrame(rows, PAGES).withColumn("payload", F.lit(1))).collect()
    first = {}
    for i, _, h in rows:
        first[h or ""] = min(first.get(h or "", i), i)
    want = {}
    for i, u, h in rows:
        data = (h or "").encode()
        low = first[h or ""]
        want[i] = (u, "response" if low == i else "revisit", base64.b32encode(hashlib.sha1(data).digest()).decode(), None if low == i else low, len(data))
    assert {r.page_id: (r.url, r.record_type, r.payload_digest, r.refers_to, r.payload_bytes) for r in found} == want
    assert len(found) == len(rows)
    assert all(bytes(r.payload) == (dict((i, h) for i, _, h in rows)[r.page_id] or "").encode() for r in found if r.record_type == "response")


def test_archives_of_an_empty_table_and_rows_without_id(spark):
    assert warc.archive(spark.createDataFrame([], PAGES)).collect() == []
    rows = spark.createDataFrame([(None, "http://a/", "x"), (1, "http://b/", "x"), (1, "http://b/", "x")], PAGES)
    assert sorted((r.page_id or -1, r.record_type) for r in warc.archive(rows).collect()) == [(-1, "response"), (1, "response"), (1, "response")]


def test_index_lookup_reads_few_blocks(spark, tmp_path):
    captures = spark.createDataFrame([(f"com,k{i:04d})/", i, "f", i, 1) for i in range(300)] + [("com,k0150)/", 1000 + i, "f", i, 1) for i in range(40)], warc.CAPTURE)
    files = [tuple(r) for r in warc.write_index(captures.coalesce(1), str(tmp_path), block=16).collect()]
    assert len(files) > 1 or files[0][0] == "com,k0000)/"
    found = []
    for first, last, name, directory, size in files:
        store, root = warc.opened(str(tmp_path))
        found += [x[1] for x in warc.lookup(["a", "com,k0150)/", "com,k0299)/", "zzz"], store, f"{root}/{name}", directory, size)]
    assert sorted(found) == [150, 299, *range(1000, 1040)]


def quality_table(spark, n=240):
    rng = random.Random(4)
    texts, good = [], []
    for k in range(n):
        lines = [prose(1000 + 10 * k + j, rng.randint(8, 40)) + "." for j in range(rng.randint(1, 5))]
        good.append(k % 3 != 0)
        texts.append("\n".join(lines if good[-1] else [" | ".join(["pad"] * 30) if rng.random() < 0.5 else "BUY NOW !! " * 20 for _ in lines]))
    table = docs(spark, texts + [None, "", " \n "])
    labels = spark.createDataFrame([(i, int(g), 0) for i, g in enumerate(good)], "doc_id long, quality int, toxic int")
    return table, labels, good


def test_quality_on_held_out_documents(spark):
    table, labels, good = quality_table(spark)
    rows = quality_crf.quality(table, labels).collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id < len(good)]
    assert sum(bool(r.predicted) == good[r.doc_id] for r in held) >= 0.95 * len(held)
    kept = {r.doc_id for r in quality_crf.keep_good(table, labels).collect()}
    assert kept == {r.doc_id for r in rows if r.predicted}


def test_quality_without_labels_or_rows(spark):
    table, labels, _ = quality_table(spark, 12)
    assert {r.score for r in quality_crf.quality(table, labels.where("false")).collect()} == {0.5}
    assert quality_crf.quality(table.where("false"), labels).collect() == []


def test_chain_marginals_by_enumeration():
    rng = np.random.default_rng(3)
    e, w = rng.normal(size=4), rng.normal(size=4)
    steps = quality_crf.Steps(np.array([0, 4]))
    a, b = steps.forward_backward(e, w)
    mass = np.zeros((4, 2))
    for y in range(16):
        bits = [y >> t & 1 for t in range(4)]
        value = np.exp(sum(e[t] for t in range(4) if bits[t]) + sum(w[2 * p + q] for p, q in zip(bits, bits[1:])))
        for t in range(4):
            mass[t, bits[t]] += value
    assert np.allclose(quality_crf.sigmoid(a + b), mass[:, 1] / mass.sum(axis=1))


def page(k, paragraphs=1):
    more = "".join(f"<p>{prose(k + 50 + j, 10 + 17 * j)}.</p>" for j in range(paragraphs - 1))
    return (f'<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">{prose(k, 2)}</a></li>'
            f'<li><a href="/b">menu</a></li></ul></nav><div class="ad">{prose(k + 1, 8)}.</div><article><h1>Title {k}</h1>{more}<p><b>{prose(k + 2, 30)}.<br><p>{prose(k + 3, 60)} &amp; &eacute;.\n\t x</p></article>'
            f"<footer>&copy; {prose(k + 4, 10)}.</footer>")


@pytest.fixture(scope="module")
def trees(spark):
    table = spark.createDataFrame([(k, "u", page(100 * k, 1 + k % 7)) for k in range(140)], PAGES)
    return html_extract.trained(table)


def test_article_text(trees):
    k = 9000
    want = f"Title {k}\n{prose(k + 2, 30)}.\n{prose(k + 3, 60)} & é. x"
    assert html_extract.extracted([page(k)], trees) == [want]


def test_self_closed_elements_hide_nothing(trees):
    k = 9000
    want = f"Title {k}\n{prose(k + 2, 30)}.\n{prose(k + 3, 60)} & é. x"
    for icon in ('<svg class="i" />', "<iframe src='x'/>", "<object/>", "<svg><path d='M0'/></svg>"):
        assert html_extract.extracted([page(k).replace("<article>", f"<article>{icon}")], trees) == [want]


def bare(k, paragraphs):
    """A page that names none of its parts."""
    return re.sub(r"<(/?)(article|nav|footer)>", r"<\1div>", page(k, paragraphs)).replace('class="ad"', 'class="x1"')


def test_held_out_pages_without_names(trees):
    """Neither tags nor class names say what the article is: structure has to."""
    hits = []
    for k in range(20_000, 24_000, 100):
        more = [f"{prose(k + 50 + j, 10 + 17 * j)}." for j in range(k // 100 % 7)]
        want = [f"Title {k}", *more, f"{prose(k + 2, 30)}.", f"{prose(k + 3, 60)} & é. x"]
        got = html_extract.extracted([bare(k, 1 + k // 100 % 7)], trees)[0].split("\n")
        hits.append(2 * len(set(got) & set(want)) / (len(set(got)) + len(set(want))))
    assert np.mean(hits) > 0.8


def test_tables_in_which_no_page_names_its_article(spark):
    table = spark.createDataFrame([(k, "u", bare(100 * k, 2 + k % 5)) for k in range(60)], PAGES)
    found = {r.page_id: r.text for r in html_extract.main_text(table).collect()}
    assert sum(prose(100 * k + 3, 60) in found[k] for k in range(60)) > 50


def test_training_pages_come_by_their_ids(spark):
    table = spark.createDataFrame([(k % 40, "u", page(100 * (k % 40))) for k in range(120)] + [(None, None, page(7))], PAGES)
    some = html_extract.chosen(table, 15, "page_id")
    assert len(some) == 15 and len(set(some)) == 15 and set(some) <= {(k, page(100 * k)) for k in range(40)} | {(None, page(7))}
    assert len(html_extract.chosen(table, 100, "page_id")) == 41


def test_parts_that_are_not_the_article(trees):
    body = "".join(f"<p>{prose(k, 50)}.</p>" for k in range(5))
    html = (f'<body><header><p>My site</p></header><div class="cookie-notice"><p>We use cookies, and more words here.</p></div><article><h1>Head</h1>{body}</article>'
            f'<aside><ul><li><a href="/x">{prose(3, 5)}</a></li></ul></aside><section class="comments"><div class="comment"><p>{prose(4, 30)}</p></div></section><form><p>Send</p></form></body>')
    assert html_extract.extracted([html], trees) == ["\n".join(["Head"] + [f"{prose(k, 50)}." for k in range(5)])]


def test_decoding_is_hierarchical_and_best():
    nodes = html_extract.nodes_of("<div><div><p>a</p><p>b</p></div><p>c</p></div>")
    parents = [n.parent.at if n.parent else -1 for n in nodes]
    rng = np.random.default_rng(6)
    for _ in range(50):
        margin = [-9.0, *rng.normal(size=len(nodes) - 1).tolist()]
        best = None
        for bits in range(3 ** len(nodes)):
            state = [bits // 3**i % 3 - 1 for i in range(len(nodes))]  # -1 rubbish, 0 outside, 1 content
            allowed = {-1: (-1,), 0: (-1, 0, 1), 1: (1, -1)}
            if state[0] != 1 and all(state[i] in allowed[state[p]] for i, p in enumerate(parents) if p >= 0):
                value = sum(m for m, s in zip(margin, state) if s == 1)
                best = value if best is None else max(best, value)
        got = html_extract.contents(nodes, margin)
        assert abs(sum(m for m, g in zip(margin, got) if g) - best) < 1e-9
        for i, p in enumerate(parents):  # below rubbish under content nothing is content again
            q, seen_gap = p, False
            while q > 0 and got[i]:
                seen_gap |= not got[q]
                assert not (seen_gap and got[q])
                q = parents[q]


def test_pages_without_text(spark, trees):
    assert html_extract.extracted([None, "", "<p", "<script>x</script>", "</div></p>"], trees)[:2] == ["", ""]
    table = spark.createDataFrame([(1, "u", None), (None, None, "<nav>x</nav>")], PAGES).withColumn("text", F.lit("mine"))
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in html_extract.main_text(table).collect()) == [(0, "", 0), (1, "", 0)]
    assert html_extract.main_text(table.where("false")).collect() == []
