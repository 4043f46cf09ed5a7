import re
from collections import Counter

import numpy as np
import pytest
from helpers import docs, prose
from pyspark.sql import functions as F

from ledgerwatch.llm import packed, phrases


def by_definition(rows, least, longest, most):
    """rows: (text, lang). In plain Python, phrase by phrase."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            w = tuple(re.findall("[^ \t]+", piece))
            n[lang] += len(w)
            f.update((lang, w[i : i + m]) for m in range(1, longest + 1) for i in range(len(w) - m + 1))
    often = {k: c for k, c in f.items() if c >= least and len(k[1]) > 1}
    out = {}
    for (lang, w), a in often.items():
        if any(g == lang and len(v) > len(w) and c >= a and any(v[i : i + len(w)] == w for i in range(len(v))) for (g, v), c in often.items()):
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, found in out.items() for i, (s, a, p, l, r) in enumerate(sorted(found)[:most]))


ODD = [None, "", " \t", "x", "A b. a B! a b", "a b\nc a b c\ra b", "é É é é", "a " * 500, "a\x1cb a\x1cb", prose(1, 400, 30), prose(1, 400, 30), prose(2, 300, 20)]


@pytest.mark.parametrize("chunk, crowded, pairs", [(phrases.CHUNK, 16, phrases.PAIRS), (300, 1 << 20, 50), (1, 0, 7)])
def test_by_definition(spark, monkeypatch, chunk, crowded, pairs):
    monkeypatch.setattr(phrases, "PAIRS", pairs)
    monkeypatch.setattr(phrases, "CROWDED", crowded)
    table = docs(spark, ODD * 2).withColumn("lang", F.when(F.col("doc_id") % 3 == 0, "de").when(F.col("doc_id") % 3 == 1, None).otherwise("und"))
    table = table.withColumns({c: F.lit(7) for c in ("chunk", "n", "phrase", "seq")}).repartition(3)
    rows = [(r.text, r.lang) for r in table.collect()]
    found = phrases.collocations(table, least=4, most=40, chunk=chunk)
    assert sorted(tuple(r) for r in found.collect()) == by_definition(rows, 4, 5, 40)
    assert {t for c, t in found.dtypes if c not in ("lang", "phrase")} == {"bigint"}


def test_nothing_frequent_and_nothing_at_all(spark):
    table = docs(spark, ["a b c", None])
    for rows in (table, table.where("false"), docs(spark, [None, ""])):
        assert phrases.collocations(rows).collect() == []


def test_products_beyond_64_bits(spark):
    row = [(0, "a b", [3 * 10**12], [3 * 10**12, 10**12], [2 * 10**12, 10**12], 10**12, 9 * 10**12)]
    table = spark.createDataFrame(row, "id long, phrase string, x array<long>, begins array<long>, ends array<long>, f long, n long")
    found = phrases.scored(table, 2, 1000).first()
    assert found.score == 1000 * 10**12 * 9 * 10**12 // (3 * 10**12 * 2 * 10**12) and (found.l, found.r) == (3 * 10**12, 2 * 10**12)


@pytest.mark.parametrize("crowded", [0, 16, 1 << 20])
def test_tiles_count_like_a_counter(monkeypatch, crowded):
    monkeypatch.setattr(phrases, "CROWDED", crowded)
    rng = np.random.default_rng(3)
    x, y = np.minimum(rng.zipf(1.2, (2, 60_000)), 10**9)
    keys, counts = phrases.pair_counts(x, y)
    want = Counter(zip(x.tolist(), y.tolist()))
    assert dict(zip(zip((keys >> 32).tolist(), (keys & 0xFFFFFFFF).tolist()), counts.tolist())) == want and (np.diff(keys) > 0).all()
    twice = phrases.summed(np.concatenate([keys, keys[::-3]]), np.concatenate([counts, counts[::-3]]))
    more = Counter(dict(zip(keys.tolist(), counts.tolist()))) + Counter(dict(zip(keys[::-3].tolist(), counts[::-3].tolist())))
    assert dict(zip(twice[0].tolist(), twice[1].tolist())) == more
    assert [len(a) for a in phrases.pair_counts(x[:0], y[:0])] == [0, 0] and [len(a) for a in phrases.summed(keys[:0], counts[:0])] == [0, 0]


def test_packed_arrays_and_ranks(spark):
    for values in ([], [0], [-1, 5, 127], [1 << 40, -(1 << 50)], list(range(1000))):
        assert packed.unpack(packed.pack(np.array(values, np.int64))).tolist() == values
        assert packed.unpack(packed.pack(np.array(sorted(values), np.int64), True)).tolist() == sorted(values)
    table = spark.range(1000).select((F.col("id") % 7).alias("f"), "id").withColumnRenamed("id", "taken_")
    rows = packed.ranked(table, [F.desc("f"), F.asc("taken_")], "place").collect()
    assert [r.place for r in sorted(rows, key=lambda r: (-r.f, r["taken_"]))] == list(range(1000))
    assert packed.ranked(table.where("false"), [F.asc("f")]).collect() == []
