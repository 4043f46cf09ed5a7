import hashlib
import math

import corpus_pipeline
import pytest
from compare import connect, differences
from helpers import roots, words
from test_text_operators import fingerprint, shares

from ledgerwatch.llm import mixing, quality_crf, simhash, substring_dedup
from ledgerwatch.llm.queries import llm_oracles, llm_queries
from ledgerwatch.llm.tables import read

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(llm_oracles()))
def test_against_sql(spark, con, name):
    assert differences(llm_queries()[name](spark, SF), con, llm_oracles()[name]) == []


@pytest.mark.parametrize("name", sorted(set(llm_queries()) - set(llm_oracles())))
def test_rows(spark, name):
    table = "pages" if name.startswith(("op8", "op10")) else "embeddings" if name.startswith("op4") else "documents"
    rows = llm_queries()[name](spark, SF).count()
    assert rows == read(spark, SF, table).count() if name != "pipeline" else rows > 0


def test_stages_keep_the_columns_of_documents(spark):
    docs = read(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).dtypes == docs.dtypes, name
        assert stage(spark, docs.where("false"), SF).collect() == [], name
    assert len(corpus_pipeline.STAGES) == 5


def test_stages_do_their_work(spark):
    docs, labels = read(spark, SF, "documents"), read(spark, SF, "labels")
    good = {r.doc_id for r in quality_crf.quality(docs, labels).where("predicted = 1").collect()}
    first = corpus_pipeline.quality(spark, docs, SF)
    assert {r.doc_id for r in first.collect()} == good
    groups = {r.doc_id: r.component for r in simhash.fingerprint_groups(first, 3).collect()}
    second = corpus_pipeline.near_duplicates(spark, first, SF)
    assert {r.doc_id for r in second.collect()} == {d for d, c in groups.items() if d == c}
    cleaned = {r.doc_id: r for r in substring_dedup.remove_repeats(second).collect()}
    third = {r.doc_id: r.text for r in corpus_pipeline.substrings(spark, second, SF).collect()}
    assert third == {d: r.text for d, r in cleaned.items() if r.n_removed == 0 or r.n_removed < r.n_words}
    taken = mixing.mix_sizes(second).agg({"taken": "sum"}).first()[0]
    out = corpus_pipeline.mixture(spark, second, SF)
    assert out.agg({"n_chars": "count"}).first()[0] > 0 and mixing.mix_sizes(out).agg({"size": "sum"}).first()[0] == taken


def test_run_by_definition(spark):
    """The whole pipeline against plain Python; only the classifier's verdicts are taken from its stage."""
    docs, labels = read(spark, SF, "documents"), read(spark, SF, "labels")
    good = {r.doc_id for r in quality_crf.quality(docs, labels).where("predicted = 1").collect()}
    rows = {r.doc_id: (r.text, r.source) for r in docs.collect() if r.doc_id in good}
    prints = {i: fingerprint(t, 3) for i, (t, _) in rows.items()}
    near = [(i, j) for i in prints for j in prints if i < j and (prints[i] ^ prints[j]).bit_count() <= 2]
    of = roots(sorted(prints), near)
    rows = {i: v for i, v in rows.items() if of[i] == i}
    first = {}
    for i, (text, _) in sorted(rows.items()):
        w = words(text)
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    left = {}
    for i, (text, source) in rows.items():
        w = words(text)
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < i:
                gone[k : k + 13] = [True] * 13
        if not any(gone) or not all(gone):
            left[i] = (" ".join(x for x, g in zip(w, gone) if not g) if any(gone) else text, source)
    sizes = {}
    for text, source in left.values():
        sizes[source] = sizes.get(source, 0) + len(words(text))
    target = shares(sizes)
    want = {}
    for i, (text, source) in left.items():
        rate = target[source] / sizes[source] if sizes[source] else 0
        drawn = int(hashlib.md5(str(i).encode()).hexdigest()[:13], 16) / 2**52
        if times := math.floor(rate) + (drawn < rate - math.floor(rate)):
            want[i] = (times, len((text or "").encode()))
    found = {}
    for r in corpus_pipeline.run(spark, SF).collect():
        assert r.round_trip
        found[r.doc_id] = (found.get(r.doc_id, (0,))[0] + 1, r.n_bytes)
    assert found == want and len(want) > 50
