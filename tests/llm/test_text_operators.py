import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import xxhash
from helpers import docs, prose, roots, words
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerwatch.llm import components, mixing, sentencepiece_nbest, simhash, substring_dedup, tables, token_counts

BPE, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " \t\n", "a", "A a A a", "word " * 3000, "é ẞ x", prose(1, 200), prose(1, 200), prose(2, 60) + "\n" + prose(1, 90)]


def removed(rows, length):
    """By definition, word by word."""
    first = {}
    for i, text in rows:
        w = words(text)
        for k in range(len(w) - length + 1):
            key = tuple(w[k : k + length])
            first[key] = min(first.get(key, 1 << 62), i)
    out = []
    for i, text in rows:
        w = words(text)
        gone = [False] * len(w)
        for k in range(len(w) - length + 1):
            if first[tuple(w[k : k + length])] < i:
                gone[k : k + length] = [True] * length
        out.append((i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    return sorted(out)


def digests(df):
    return sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect())


def test_substrings_by_definition(spark):
    shared = prose(9, 80)
    texts = ODD + [f"{prose(k, 30)} {shared} {prose(k + 50, 20)}" for k in range(40)] + ["the the the " * 30 for _ in range(20)]
    rows = list(zip(range(len(texts)), texts))
    assert digests(substring_dedup.remove_repeats(docs(spark, texts), keep="digest")) == removed(rows, 13)
    assert digests(substring_dedup.remove_repeats(docs(spark, texts), length=3, keep="digest", block_bytes=200, bucket_bytes=100)) == removed(rows, 3)


def test_substrings_null_and_repeated_ids(spark):
    text = prose(3, 50)
    out = substring_dedup.remove_repeats(docs(spark, [text, text, text, text], [None, 5, 5, 9])).collect()
    assert sorted(((r.doc_id or -1), r.n_removed) for r in out) == [(-1, 50), (5, 0), (5, 0), (9, 50)]
    assert {r.text for r in out if r.doc_id == 5} == {text} and {r.text for r in out if r.doc_id == 9} == {""}


def test_substrings_empty_table_and_clashing_columns(spark):
    empty = docs(spark, ["x"]).where("false")
    assert substring_dedup.remove_repeats(empty, keep="digest").collect() == []
    clash = docs(spark, ["a b", "c"]).withColumns({"n_words": F.lit("mine"), "block": F.lit(1)})
    out = substring_dedup.remove_repeats(clash)
    assert out.columns == [*clash.columns, "n_words_", "n_removed"]
    assert sorted((r.n_words, r.n_words_) for r in out.collect()) == [("mine", 1), ("mine", 2)]


def test_equal_hashes_are_compared_word_by_word(monkeypatch):
    """Even if all windows had one hash, different ones are told apart."""
    monkeypatch.setattr(substring_dedup, "window_hashes", lambda h, at, length: np.zeros(len(at), np.uint64))
    texts = ["a b c d", "b c d e", "x y z", "a b c"]
    frequent = np.zeros(1 << substring_dedup.SLOT_BITS, bool)
    table = pa.table({"doc_id": [1, 2, 3, 4], "text": texts})
    rows = [(0, *p) for p in substring_dedup.Block(table, "doc_id", 3, frequent).packed(1)]
    packed = pa.table({"block": pa.array([r[0] for r in rows], pa.int32()), "meta": [r[2] for r in rows], "text": [r[3] for r in rows]})
    block = substring_dedup.Block(table, "doc_id", 3, frequent)
    gone = substring_dedup.covered(block, [v for _, v in substring_dedup.answers(packed, 3)], 3)
    assert gone.tolist() == [False] * 4 + [True] * 3 + [False] + [False] * 3 + [True] * 3


def test_token_counts_agree_with_the_library():
    own = Tokenizer.from_file(BPE)
    texts = [t or "" for t in ODD] + ["a<|endoftext|>b<|startoftext|>", "<|endoftext|><|endoftext|>", "ΟΔΟΣ Σ", "don't I'LL", "é ẍ", "½ ٣ 漢字かな", "İ ǅ", "aaaaaaaaaaaaaaa", "\x1c\x85x"]
    size, tokens = token_counts.token_counts(pa.array(texts), BPE)
    assert tokens.tolist() == [len(e.ids) for e in own.encode_batch(texts, add_special_tokens=False)]
    assert size.tolist() == [len(t.encode()) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aAbé'sΣσ 12\n\t<|>endoftext!?漢́ﬁİß ", max_size=30), max_size=8))
def test_token_counts_of_any_text(texts):
    own = Tokenizer.from_file(BPE)
    assert token_counts.token_counts(pa.array(texts, pa.string()), BPE)[1].tolist() == [len(e.ids) for e in own.encode_batch(texts, add_special_tokens=False)]


def test_token_count_table(spark):
    table = docs(spark, [None, "", "one two three"]).withColumn("n_tokens", F.lit("mine"))
    out = token_counts.count_tokens(table, BPE, limit=2, keep=("doc_id", "n_tokens"))
    assert [tuple(r) for r in out.orderBy("doc_id").collect()] == [(0, "mine", 0, 0, False), (1, "mine", 0, 0, False), (2, "mine", 13, 3, True)]
    assert token_counts.count_tokens(table.where("false"), BPE).collect() == []


def fingerprint(text, size):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("fetched", [64, 1])
def test_simhash_by_definition(spark, monkeypatch, fetched):
    monkeypatch.setattr(simhash, "FETCHED", fetched)
    base = prose(4, 300)
    texts = ODD + [base.replace("w7 ", f"v{k} ", 1) for k in range(30)] + [base] * 5 + [prose(k, 40) for k in range(60, 80)]
    prints = {i: fingerprint(t, 3) for i, t in enumerate(texts)}
    near = [(i, j) for i in prints for j in prints if i < j and (prints[i] ^ prints[j]).bit_count() <= 2]
    want = roots(prints, near)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs(spark, texts)).collect()}
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in prints}


def test_hamming_links_are_complete(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centre = int(rng.integers(1 << 62))
    values = {centre} | {centre ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 62, (150, 2))} | {int(x) for x in rng.integers(1 << 62, size=50)}
    want = {(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 2}
    for fetched in (64, 4):
        monkeypatch.setattr(simhash, "FETCHED", fetched)
        found = simhash.links(spark.createDataFrame([(v,) for v in values], "fp long")).collect()
        assert {(r.a, r.b) for r in found} == want and len(found) == len(want)


def test_links_send_no_large_side_through_the_driver(spark, monkeypatch):
    """Spark takes tables for small that aren't: by the size of compressed files, and as an explode counts for nothing."""
    plans, stored = [], simhash.cut_lineage

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df)

    for module in (simhash, components):
        monkeypatch.setattr(module, "cut_lineage", noted)
    monkeypatch.setattr(tables, "SMALL_SIDE", 10, raising=False)
    base = prose(4, 300)
    table = docs(spark, [base.replace("w7 ", f"v{k} ", 1) for k in range(30)] + [prose(k, 40) for k in range(60, 80)])
    plans.append(simhash.near_duplicates(table)._jdf.queryExecution().executedPlan().toString())
    assert sum("SortMergeJoin" in p for p in plans) > 4 and not [p for p in plans if "Broadcast" in p]


def test_one_of_each_group_stays(spark):
    texts = [prose(1, 50), prose(1, 50), prose(2, 50), None, "", prose(1, 50)]
    table = docs(spark, texts, [7, 3, 4, 5, 6, None]).withColumn("gone", F.lit(0))
    assert sorted((r.doc_id or -1) for r in simhash.one_of_each(table).collect()) == [-1, 3, 4, 5]
    assert simhash.one_of_each(table.where("false")).collect() == []


def test_stage_of_near_copies_by_definition(spark):
    rng = np.random.default_rng(6)
    texts = ODD[:]
    for k in range(12):
        base = prose(700 + k, 900).split()
        texts.append(" ".join(base))
        for edits in (1, 1, 2, 5):
            copy = base[:]
            for i in rng.integers(0, len(base), edits):
                copy[i] = f"edit{rng.integers(1 << 30)}"
            texts.append(" ".join(copy))
    prints = {i: fingerprint(t, 3) for i, t in enumerate(texts)}
    near = [(i, j) for i in prints for j in prints if i < j and (prints[i] ^ prints[j]).bit_count() <= 2]
    want = roots(prints, near)
    assert sum(0 < (prints[i] ^ prints[j]).bit_count() for i, j in near) > 10
    kept = {r.doc_id for r in simhash.one_of_each(docs(spark, texts)).collect()}
    assert kept == {i for i in want if want[i] == i}


def shares(sizes, weights=(3, 1, 2), total=1.5, most=2):
    """Water filling in rounds, as the text describes it."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target = {}
    while True:
        free = [s for s in names if s not in target]
        left = total * sum(sizes.values()) - sum(target.values())
        level = left / sum(weight[s] for s in free) if free else 0
        full = [s for s in free if level * weight[s] >= most * sizes[s]]
        if not full:
            return target | {s: level * weight[s] for s in free}
        target |= {s: most * sizes[s] for s in full}


def test_mix_keeps_columns_of_its_own_names(spark):
    table = docs(spark, ["a b"] * 8, sources=["x", "y"] * 4).withColumns({c: F.lit(c) for c in ("_of", "_source", "_rate", "target")})
    out = mixing.mix(table)
    assert out.columns == table.columns and {(r["_of"], r["_source"], r["_rate"], r["target"]) for r in out.collect()} == {("_of", "_source", "_rate", "target")}


def test_mixing_targets_and_whole_copies(spark):
    texts, sources = [prose(k, 5 + 7 * (k % 9)) for k in range(90)] + [None, "", "x"], ["b", "a", None, "Ä", "c"] * 18 + ["z", "z", "a"]
    out = mixing.mix_sizes(docs(spark, texts, sources=sources)).collect()
    by_source = {}
    for t, s in zip(texts, sources):
        by_source[s] = by_source.get(s, 0) + len(words(t))
    want = shares(by_source)
    for r in out:
        s = sources[r.doc_id]
        assert (r.size, r.source_size) == (len(words(texts[r.doc_id])), by_source[s]) and abs(r.target - want[s]) < 1e-6
        rate = r.target / r.source_size if r.source_size else 0
        assert r.size == 0 or r.taken // r.size in (int(rate), int(rate) + 1) and r.taken <= 2 * r.size
    again = {r.doc_id: r.taken for r in mixing.mix_sizes(docs(spark, texts, sources=sources).repartition(5)).collect()}
    assert again == {r.doc_id: r.taken for r in out}
    copied = mixing.mix(docs(spark, texts, sources=sources))
    counts = {r.doc_id: r["count"] for r in copied.groupBy("doc_id").count().collect()}
    assert copied.columns == docs(spark, ["x"]).columns
    assert all(counts.get(r.doc_id, 0) * r.size == r.taken for r in out)


def test_mixing_empty_tables(spark):
    none = docs(spark, ["x"]).where("false")
    assert mixing.mix_sizes(none).collect() == [] and mixing.mix(none).collect() == []
    assert [r.taken for r in mixing.mix_sizes(docs(spark, ["", None])).collect()] == [0, 0]


def n_best(model, text, n):
    marked = sentencepiece_nbest.MARK + text.replace(" ", sentencepiece_nbest.MARK) if text else ""
    best = {0: [0.0]}
    for end in range(1, len(marked) + 1):
        found = [s + model.scores[i] for begin in range(max(0, end - model.longest), end) if (i := model.ids.get(marked[begin:end])) is not None for s in best[begin]]
        if marked[end - 1] not in model.ids:
            found += [s + model.floor for s in best[end - 1]]
        best[end] = sorted(found, reverse=True)[:n]
    return best[len(marked)]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="abeint hT\n\t漢é😀  .<", max_size=25), max_size=6))
def test_pieces_are_the_n_best_and_decode(texts):
    model = sentencepiece_nbest.model(PIECES)
    found = sentencepiece_nbest.encoded(pa.array(texts, pa.string()), PIECES, 4)
    assert found["scores"] == [n_best(model, t, 4) for t in texts]
    flat, ends = sentencepiece_nbest.decoded(found["ids"], found["offsets"], PIECES)
    raw = flat.tobytes()
    assert [raw[a:b].decode() for a, b in zip(ends, ends[1:])] == texts
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    ids = [found["ids"][a:b].tolist() for a, b in zip(found["offsets"], found["offsets"][1:])]
    assert [library.decode(x) for x in ids] == texts
    for each, text, scores, first in zip(found["lists"], texts, found["scores"], ids):
        assert len(each) == len(scores) and each[0].tolist() == first and len({tuple(x) for x in map(np.ndarray.tolist, each)}) == len(each)
        for x, score in zip(each, scores):  # every one of the n best decodes to the text, and has the score that it is listed with
            assert library.decode(x.tolist()) == text
            spelled = [i for i in x.tolist() if not library.is_byte(i) and not library.is_unknown(i)]
            others = sum(c not in model.ids for c in ("▁" + text.replace(" ", "▁") if text else ""))
            assert abs(sum(model.scores[i] for i in spelled) + others * model.floor - score) < 1e-6


def test_pieces_of_a_long_text_and_a_table(spark):
    long = "x" * 4000 + " " + prose(3, 3000)
    table = docs(spark, [None, "", long, "a b"]).withColumn("ids", F.lit("mine"))
    out = sentencepiece_nbest.encode(table, PIECES, n=3, keep=("doc_id", "ids"))
    rows = {r.doc_id: r for r in out.collect()}
    assert all(r.round_trip and r.ids == "mine" for r in rows.values()) and len(rows[2].nbest_scores) == 3
    assert (rows[0].n_pieces, rows[1].n_pieces, rows[0].nbest_scores, rows[0].nbest_ids) == (0, 0, [0.0], [[]])
    assert [len(x) for x in rows[2].nbest_ids] == rows[2].nbest_pieces and rows[2].nbest_ids[0] == rows[2].ids_
    further = out.select("doc_id", F.explode("nbest_ids").alias("ids"))
    assert {(r.doc_id, r.text) for r in sentencepiece_nbest.decode(further, PIECES).collect()} == {(0, ""), (1, ""), (2, long), (3, "a b")}
    digests = sentencepiece_nbest.encode(table, PIECES, n=3, ids="digest", keep=("doc_id",)).where("doc_id = 2").first()
    assert digests.nbest_sha256 == [hashlib.sha256(np.array(x, "<i4").tobytes()).hexdigest() for x in rows[2].nbest_ids]
    back = sentencepiece_nbest.decode(out.select("doc_id", F.col("ids_").alias("ids")), PIECES)
    assert {r.doc_id: r.text for r in back.collect()} == {0: "", 1: "", 2: long, 3: "a b"}
    assert sentencepiece_nbest.encode(table.where("false"), PIECES).collect() == []
