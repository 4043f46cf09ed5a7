import hashlib
from collections import Counter

import public_tokenizers as P
import pyarrow as pa
import pytest
import sentencepiece
from helpers import docs, prose
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerwatch.llm import alignment
from ledgerwatch.llm.queries import llm_queries
from ledgerwatch.llm.tables import read
from ledgerwatch.llm.token_counts import byte_symbols

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ODD = [None, "", " ", "  ", "a", "a ", "a  ", " a  b", "漢字 かな😀 é x", "<s> <|endoftext|> <0x41> </s>", "a▁b c", "x\ny \n z\t", "a" * 900, " " * 300, "é ü　ö x",
       "\x00 \x1c a", prose(1, 700), prose(1, 700), prose(2, 300) + "\n" + prose(3, 90)]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def aligned(text, libraries):
    """Groups [(A ids, B ids)] of a whole text by decoded bytes."""
    a, b = libraries
    byte_of = {c: i for i, c in enumerate(byte_symbols())}
    if not text:
        return []
    a_ids, b_ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    a_bytes = [bytes(map(byte_of.__getitem__, a.id_to_token(i))) for i in a_ids]
    b_bytes = [bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in b_ids]
    if b"".join(a_bytes) != (" " + text).encode() or b"".join(b_bytes) != (" " + text).encode():
        return []
    cuts = []
    for tokens in (a_bytes, b_bytes):
        at, ends = 0, []
        for t in tokens:
            at += len(t)
            ends.append(at)
        cuts.append(ends)
    common = sorted(set(cuts[0]) & set(cuts[1]))
    inside = lambda ids, ends, lo, hi: [i for i, e in zip(ids, ends) if lo < e <= hi]
    return [(inside(a_ids, cuts[0], lo, hi), inside(b_ids, cuts[1], lo, hi)) for lo, hi in zip([0, *common], common)]


def by_definition(rows, libraries):
    found = {i: aligned(t, libraries) for i, t in rows}
    links = {i: Counter((x, y) for a, b in g for x in a for y in b) for i, g in found.items()}
    count = Counter(p for own in links.values() for p in own)
    most = {}
    for (x, _), c in count.items():
        most[x] = max(c, most.get(x, 0))
    shown = {i: ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g) for i, g in found.items()}
    return {i: (sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(links[i].values()),
                sum(n for p, n in links[i].items() if count[p] == most[p[0]]), sum(n * count[p] for p, n in links[i].items()), shown[i]) for i, g in found.items()}


@pytest.mark.parametrize("chunk, keys", [(alignment.CHUNK, alignment.KEYS), (2000, 3)])
def test_by_definition(spark, libraries, monkeypatch, chunk, keys):
    monkeypatch.setattr(alignment, "KEYS", keys)
    table = docs(spark, ODD).withColumns({c: F.lit("mine") for c in ("chunk", "n_a", "groups", "told")}).repartition(3)
    found = alignment.align(table, A, B, keep=("doc_id", "n_a"), chunk=chunk)
    assert found.columns == ["doc_id", "n_a", "n_a_", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    assert {r[0]: tuple(r)[2:] for r in found.collect()} == by_definition(list(enumerate(ODD)), libraries)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="ab é'sS1 2\n\t\r漢　\xa0😀.,!-_İß\x1c\x85​́theing▁<>", max_size=50), max_size=6))
def test_groups_of_any_text(libraries, texts):
    found = alignment.packed_chunk(alignment.pair_of(A, B), pa.array(texts, pa.string()), "text")
    want = by_definition(list(enumerate(texts)), libraries)
    assert [tuple(int(found[c][i]) for c in alignment.COUNTS) + (found["groups"][i],) for i in range(len(texts))] == [want[i][:4] + want[i][6:] for i in range(len(texts))]


def test_coarse_cuts_are_refined(libraries):
    """Several tokens in one character, and pieces of bytes."""
    pair = alignment.Pair(A, B)
    (a_id, _, a_end), (b_id, _, b_end), right = pair.spans([" 漢\U00013000"])
    assert right.tolist() == [True] and a_end.tolist()[-1] == b_end.tolist()[-1] == 8
    assert (a_end[1:] > a_end[:-1]).all() and (b_end[1:] > b_end[:-1]).all() and pair.fallback[b_id].any()


def test_null_ids_repeated_rows_and_nothing(spark, libraries):
    table = docs(spark, ["a b", "a b", "a b", None], [None, 5, 5, 5])
    found = alignment.align(table, A, B).collect()
    assert sorted((r.doc_id or 0, r.count_sum) for r in found) == [(0, 6), (5, 0), (5, 6), (5, 6)]
    assert alignment.align(table.where("false"), A, B).collect() == []


def test_query_by_definition(spark, libraries):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in read(spark, sf, "documents").select("doc_id", "text").collect()]
    want = {i: w[:6] + (hashlib.sha256(w[6].encode()).hexdigest() if w[6] else "",) for i, w in by_definition(rows, libraries).items()}
    found = llm_queries()["op11_alignment"](spark, sf)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert {r.doc_id: tuple(r)[1:] for r in found.collect()} == want
