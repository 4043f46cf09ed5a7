import base64
import hashlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from helpers import docs, prose
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerwatch.llm import byte_bpe
from ledgerwatch.llm.queries import llm_queries
from ledgerwatch.llm.tables import read

PATH = P.path("byte_bpe_multi_50k.tiktoken")
ODD = [None, "", " ", "  a ", "a  b\n c\t\n", "\x1c a \x85 b   c　 d", "don't I'LL we've", "a" * 3000, " " * 700 + "x", "漢字かな 😀😀 é" * 50,
       "<|endoftext|> x", "½ ٣٤ 12 345", "İ ß ǅ ́", "\r\n \r\n x", "xyz" * 200, "\x00 \x7f a", prose(1, 3000), prose(1, 3000)]


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.Ranks(PATH, P.PATTERN)


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoded(ranks, texts):
    ids, first = ranks.encode(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:])]


def test_ids_are_the_library_s(ranks, library):
    assert encoded(ranks, ODD) == [library.encode_ordinary(t or "") for t in ODD]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab é'sS1 2\n\t\r漢　\xa0😀.,!-_İß\x1c\x85​́theing", max_size=60), max_size=8))
def test_ids_of_any_text(ranks, library, texts):
    assert encoded(ranks, texts) == [library.encode_ordinary(t) for t in texts]


def test_query_and_heap_contract_alike(ranks):
    words = [t.encode() for t in ("abab" * 40, " " * 200, "thethethe" * 20, "ananasanana", "é" * 60)]
    by_query = [list(x) for ids, sizes in ranks.merged(words) for x in np.split(ids, sizes.cumsum()[:-1])]
    assert by_query == [ranks.contracted(w).tolist() for w in words]


def test_forgetting_changes_nothing(ranks, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 0)
    monkeypatch.setattr(byte_bpe, "WORDS", 7)
    monkeypatch.setattr(byte_bpe, "TOKENS", 5)
    for _ in range(2):
        assert encoded(ranks, ODD) == [library.encode_ordinary(t or "") for t in ODD]
    ids, first = ranks.encode(pa.array(ODD, pa.string()))
    assert ranks.decode(ids, first) == [(t or "").encode() for t in ODD]


def test_tables(spark):
    table = docs(spark, ODD).withColumn("ids", F.lit("mine")).withColumn("decoded", F.lit("too"))
    found = byte_bpe.encode(table, PATH, P.PATTERN, keep=("doc_id", "text", "ids", "decoded"))
    assert found.columns == ["doc_id", "text", "ids", "decoded", "ids_"]
    back = byte_bpe.decode(found.withColumn("ids_", F.when(F.col("doc_id") != 3, F.col("ids_"))), PATH, P.PATTERN, "ids_")
    rows = {r.doc_id: r for r in back.collect()}
    assert back.columns[-1] == "decoded_" and rows[3]["decoded_"] is None
    assert all(bytes(r["decoded_"]) == (r.text or "").encode() for i, r in rows.items() if i != 3)
    assert byte_bpe.encode(table.where("false"), PATH, P.PATTERN).collect() == []
    with pytest.raises(Exception, match="not in the vocabulary"):
        byte_bpe.decode(spark.createDataFrame([([1, 10**6],)], "ids array<int>"), PATH, P.PATTERN).collect()
    with pytest.raises(Exception, match="not in the vocabulary"):
        byte_bpe.decode(spark.createDataFrame([([1, None],)], "ids array<int>"), PATH, P.PATTERN).collect()


def test_query_by_the_library(spark, library):
    sf = "/root/testdata/sf0.001"
    digest = lambda data: hashlib.sha256(data).hexdigest()
    want = {}
    for r in read(spark, sf, "documents").select("doc_id", "text").collect():
        ids = library.encode_ordinary(r.text or "")
        want[r.doc_id] = (len(ids), digest(",".join(map(str, ids)).encode()), digest((r.text or "").encode()))
    found = llm_queries()["op12_byte_bpe"](spark, sf)
    assert dict(found.dtypes)["n_tokens"] == "bigint"
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in found.collect()} == want
