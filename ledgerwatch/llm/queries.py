"""The numbered queries over the given tables, and the SQL that checks those it can express."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, byte_bpe, embedding_dedup, html_extract, maxscore, mixing, phrases, quality_crf, sentencepiece_nbest, simhash, substring_dedup, token_counts, warc
from .tables import read

WORD_BPE = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"
BYTE_BPE = "byte_bpe_50k.json"
RANKS = "byte_bpe_multi_50k.tiktoken"


def substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(read(spark, sf_dir, "documents"), keep="digest")


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(read(spark, sf_dir, "embeddings"))


def top_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def mixed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sizes(read(spark, sf_dir, "documents"))


def pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_nbest.encode(
        read(spark, sf_dir, "documents"), public_tokenizers.path(PIECES), ids="digest", keep=("doc_id",))


def archived(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archive(read(spark, sf_dir, "pages"), payload=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(read(spark, sf_dir, "pages"))


def document_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_crf.quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(read(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), public_tokenizers.path(PIECES), groups="digest")


def byte_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    found = byte_bpe.decode(byte_bpe.encode(read(spark, sf_dir, "documents"), path, pattern), path, pattern)
    return found.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring_dedup": substring,
        "op2_token_counts": tokens,
        "op3_simhash": near_copies,
        "op4_embedding_dedup": near_vectors,
        "op5_maxscore": top_vectors,
        "op6_mixing": mixed_sources,
        "op7_sentencepiece": pieces,
        "op8_warc": archived,
        "op9_quality": document_quality,
        "op10_html_extract": page_text,
        "op11_alignment": aligned,
        "op12_byte_bpe": byte_pieces,
        "op13_phrases": collocations,
        "pipeline": pipeline,
    }


WORDS = r"'[^\x20\x09-\x0D]+'"

SUBSTRING_SQL = rf"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), {WORDS}) AS w FROM documents
), placed AS (
  SELECT doc_id, unnest(range(1, len(w) - 11)) AS pos, w FROM words WHERE len(w) >= 13
), windows AS (
  SELECT doc_id, pos, array_to_string(w[pos : pos + 12], ' ') AS win FROM placed
), earliest AS (
  SELECT win, min(doc_id) AS low FROM windows GROUP BY win
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(pos, pos + 13)) AS pos
  FROM windows JOIN earliest USING (win) WHERE low < doc_id
), lists AS (
  SELECT doc_id, list(pos) AS gone FROM gone GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(array_to_string(list_filter(w, lambda x, i: gone IS NULL OR NOT list_contains(gone, i)), ' ')) AS kept_sha256
FROM words LEFT JOIN lists USING (doc_id)
"""

MIXING_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {WORDS}))::BIGINT AS size FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [3, 1, 2][(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1] AS weight
  FROM sized GROUP BY source
), levels AS (
  SELECT source, source_size, weight,
    ((SELECT sum(source_size) FROM sources)::DOUBLE * 1.5 - coalesce(sum(2 * source_size) OVER (
      ORDER BY 2 * source_size / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / (sum(weight) OVER (ORDER BY 2 * source_size / weight, encode(source) NULLS LAST
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM sources
), chosen AS (
  SELECT arg_min(level, place) AS level FROM (SELECT *, row_number() OVER (ORDER BY 2 * source_size / weight, encode(source) NULLS LAST) AS place FROM levels)
  WHERE level * weight < 2 * source_size
), targets AS (
  SELECT source, source_size, coalesce(least(chosen.level * weight, 2 * source_size), 2 * source_size)::DOUBLE AS target
  FROM levels CROSS JOIN chosen
), drawn AS (
  SELECT doc_id, size, source_size, target, target / nullif(source_size, 0) AS rate,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496 AS u
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
)
SELECT doc_id, size, source_size, target,
  coalesce(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END), 0)::BIGINT AS taken
FROM drawn
"""


MAXSCORE_SQL = """
WITH usable AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
), scores AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM usable q JOIN usable c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM scores
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

PHRASES_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL
), worded AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), sizes AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM worded GROUP BY lang
), lengths AS (
  SELECT unnest([1, 2, 3, 4, 5]) AS m
), placed AS (
  SELECT lang, m, w, unnest(range(1, len(w) - m + 2)) AS pos FROM worded JOIN lengths ON len(w) >= m
), often AS (
  SELECT lang, m, w[pos : pos + m - 1] AS words, count(*) AS f FROM placed GROUP BY ALL HAVING count(*) >= 100
), cuts AS (
  SELECT lang, m, words, f, unnest(range(1, m)) AS k FROM often WHERE m > 1
), cut_scores AS (
  SELECT c.lang, c.m, c.words, c.f AS a, k, l.f AS l, r.f AS r, n, ((1000::HUGEINT * c.f * n) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM cuts c JOIN sizes USING (lang)
  JOIN often l ON l.lang = c.lang AND l.words = c.words[: k]
  JOIN often r ON r.lang = c.lang AND r.words = c.words[k + 1 :]
), lowest AS (
  SELECT *, row_number() OVER (PARTITION BY lang, words ORDER BY score, k) AS place FROM cut_scores
), inside AS (
  SELECT lang, words[s : s + t - 1] AS words, max(f) AS more
  FROM (SELECT lang, words, f, m, t, unnest(range(1, m - t + 2)) AS s FROM often, (SELECT unnest([2, 3, 4]) AS t) WHERE m > t)
  GROUP BY ALL
), kept AS (
  SELECT lang, array_to_string(words, ' ') AS phrase, a, l, r, n, score
  FROM lowest LEFT JOIN inside USING (lang, words) WHERE place = 1 AND NOT coalesce(100 * more >= 100 * a, false)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""


def llm_oracles() -> dict[str, str]:
    return {"op1_substring_dedup": SUBSTRING_SQL, "op5_maxscore": MAXSCORE_SQL, "op6_mixing": MIXING_SQL, "op13_phrases": PHRASES_SQL}
