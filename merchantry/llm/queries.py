"""The registered queries of this subpackage, each over whole tables with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from merchantry.llm import (
    binary,
    decontaminate,
    fingerprints,
    language,
    licences,
    lines,
    neardup,
    packing,
    phrases,
    pii,
    quality,
    runs,
    shards,
)
from merchantry.llm.session import prepare
from merchantry.sources.shared import shared_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score_documents(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language.identify(docs, language.train(docs))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "token-files")
    docs = _table(spark, sf_dir, "documents")
    binary.write_token_files(docs, path, public_tokenizers.path("word_bpe_49k.json"))
    return binary.read_token_files(spark, path, digest=True)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents")).drop("set_key")


def op6_uniform_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = _table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"),
    )
    dealt = shards.shuffle_into_shards(docs, 8)
    return dealt.withColumn("grown_shard", F.lit(None).cast("int"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_table(spark, sf_dir, "documents"))


def op8_packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(_table(spark, sf_dir, "documents"))


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return licences.scan_licences(docs, licences.train(docs))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


def op12_shared_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_digests(_table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.periodic_runs(_table(spark, sf_dir, "documents"), changed=True).drop("n_words")


QUERIES = {f.__name__: f for f in (
    op1_quality_classifier, op2_language_id, op3_token_files, op4_decontamination, op5_near_duplicates,
    op6_uniform_shards, op7_personal_data, op8_packed_sequences, op9_fingerprints, op10_licences,
    op11_collocations, op12_shared_lines, op13_periodic_runs,
)}

# op5: every pair of documents that share a shingle, counted; op11: every sequence of words, counted;
# op12: every line, joined with the keys of frequent ones; the others have no SQL form and are tested
# against brute force (learned models, byte-pair merges, random draws, sketches, learned contexts)
ORACLES = {
    "op5_near_duplicates": r"""WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
      sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s FROM words),
      each AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
      pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS c
        FROM each a JOIN each b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
      links AS (SELECT x, y FROM pairs WHERE 100 * c >= 85 * (n + m - c)),
      reached AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION
        SELECT r.x, l.y FROM reached r JOIN links l ON r.y = l.x),
      least AS (SELECT x, min(y) AS component_id FROM reached GROUP BY 1)
    SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, l.component_id, s.doc_id = l.component_id AS kept
    FROM sets s JOIN least l ON s.doc_id = l.x""",
    "op11_collocations": r"""WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(
        coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents),
      words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
      spans AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
      grams AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, m FROM spans, range(1, 6) AS t(m)
        WHERE i + m - 1 <= len(w)),
      f AS (SELECT lang, phrase, any_value(m) AS m, count(*) AS c FROM grams GROUP BY 1, 2),
      totals AS (SELECT lang, sum(c) AS n FROM f WHERE m = 1 GROUP BY 1),
      often AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE c >= 100),
      cuts AS (SELECT p.lang, p.phrase, p.m, p.c AS a, k, l.c AS l, r.c AS r, t.n,
          (1000::HUGEINT * p.c * t.n) // (l.c::HUGEINT * r.c) AS score
        FROM (SELECT *, unnest(range(1, m)) AS k FROM often) p
        JOIN often l ON l.lang = p.lang AND l.phrase = array_to_string(p.w[1:k], ' ')
        JOIN often r ON r.lang = p.lang AND r.phrase = array_to_string(p.w[k + 1:], ' ')
        JOIN totals t ON t.lang = p.lang),
      best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
      held AS (SELECT DISTINCT lang, array_to_string(w[i:i + j - 1], ' ') AS phrase, c
        FROM (SELECT *, unnest(range(2, m)) AS j FROM often) x, range(1, 5) AS t(i) WHERE i + j - 1 <= m),
      kept AS (SELECT b.* FROM best b WHERE NOT EXISTS (SELECT 1 FROM held h
        WHERE h.lang = b.lang AND h.phrase = b.phrase AND 100 * h.c >= 100 * b.a)),
      ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
    SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l,
      CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 2000""",
    "op12_shared_lines": r"""WITH docs AS (SELECT row_number() OVER () AS d, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls
        FROM documents),
      each AS (SELECT d, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i FROM docs),
      keyed AS (SELECT d, i, line, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''),
        '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM each),
      often AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT d) >= 10),
      kept AS (SELECT d, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS rest FROM keyed
        WHERE key NOT IN (SELECT key FROM often) GROUP BY d)
    SELECT doc_id, CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - coalesce(n, 0) AS BIGINT) AS n_dropped,
      sha256(coalesce(rest, '')) AS kept_sha256 FROM docs LEFT JOIN kept USING (d)""",
}
