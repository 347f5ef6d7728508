"""The pipeline stage by stage, and the registered queries, against brute force at sf0.001."""

import hashlib
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from merchantry.llm.queries import ORACLES, QUERIES
from tests.llm.edge import documents, empty
from tests.llm.test_neardup import brute_force
from tests.llm.test_personal_data import plain_spans
from tests.llm.test_tokens import BYTE, WORD, check_packed, ids_of
from tests.oracle import connect, differences

DIRECTORY = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet(f"{DIRECTORY}/documents.parquet")


@pytest.fixture(scope="module")
def texts(corpus):
    return {r["doc_id"]: r["text"] for r in corpus.collect()}


@pytest.fixture(scope="module")
def stages(spark, corpus, tmp_path_factory):
    """The table before every stage, and the result."""
    base, tables = tmp_path_factory.mktemp("stages"), [corpus]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, tables[-1], DIRECTORY).write.parquet(f"{base}/{name}")
        tables.append(spark.read.parquet(f"{base}/{name}"))
    return tables


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_stage_names_and_columns(stages, corpus):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "personal_data", "packing"]
    assert all(t.dtypes == corpus.dtypes for t in stages[:-1])


def test_language_stage_keeps_clean_documents(stages):
    assert {r[0] for r in rows_of(stages[1])} == {i for i, t in rows_of(stages[0]) if t and re.search(r"[^\W\d_]", t)}


def test_dedup_stage_keeps_one_of_each_group(stages):
    assert sorted(r[0] for r in rows_of(stages[2])) == sorted(d for d, _, _, kept in brute_force(rows_of(stages[1]), 80) if kept)


def test_decontamination_stage_drops_passages(spark, stages):
    def plain(text):
        return f" {' '.join(re.findall(r'\w+', text.lower()))} "

    items = [plain(r["text"]) for r in spark.read.parquet(f"{DIRECTORY}/benchmark.parquet").collect()]
    clean = {i for i, t in rows_of(stages[2]) if not any(x in plain(t) for x in items)}
    assert {r[0] for r in rows_of(stages[3])} == clean


def test_masking_stage_leaves_no_fixed_match(stages):
    before = dict(rows_of(stages[3]))
    after = dict(rows_of(stages[4]))
    assert before.keys() == after.keys()
    for doc_id, text in before.items():
        spans = plain_spans(text)
        assert (after[doc_id] == text) == (not spans)
        assert not any(text[s:e] in after[doc_id] for s, k, e in spans if k < 2 or e - s > 12)


def test_packing_stage(stages):
    bins, tokens = check_packed(stages[5].collect(), rows_of(stages[4]), 1024)
    assert bins <= 1.02 * tokens / 1024 + 1


def test_run_equals_the_stages(spark, stages):
    digest = ["doc_id", "piece", "start", "length", "ids_crc32"]
    got = corpus_pipeline.run(spark, DIRECTORY).select(*digest)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, stages[5].select(*digest).collect()))


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_edge_rows_and_nothing(spark, name):
    df = documents(spark)
    out = STAGES[name](spark, df, DIRECTORY)
    if name != "packing":
        assert out.dtypes == df.dtypes
    out.collect()
    assert STAGES[name](spark, empty(spark), DIRECTORY).count() == 0


def collected(spark, prefix):
    name = next(n for n in QUERIES if n.startswith(f"{prefix}_"))
    return QUERIES[name](spark, DIRECTORY)


def test_all_are_registered():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("prefix", ["op1", "op2", "op10"])
def test_learned_queries_cover_every_document(spark, texts, prefix):
    assert sorted(r["doc_id"] for r in collected(spark, prefix).collect()) == sorted(texts)


def test_token_files(spark, texts):
    at = 0
    for r in sorted(collected(spark, "op3").collect(), key=lambda r: r["doc_id"]):
        ids = np.array([*ids_of(WORD, texts[r["doc_id"]]), 1], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_near_duplicates(spark, texts):
    got = sorted(tuple(r) for r in collected(spark, "op5").collect())
    assert got == sorted(brute_force(sorted(texts.items())))


@pytest.mark.parametrize("name", list(ORACLES))
def test_queries_equal_their_sql(spark, name):
    assert differences(QUERIES[name](spark, DIRECTORY), connect(DIRECTORY), ORACLES[name]) == []


def test_uniform_shards(spark, texts):
    rows = collected(spark, "op6").collect()
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 1, zlib.crc32(raw), "rows")
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    assert {len([r for r in rows if r["shard"] == s]) for s in range(8)} == {25}


def test_personal_data(spark, texts):
    for r in collected(spark, "op7").collect():
        spans = plain_spans(texts[r["doc_id"]])
        joined = ",".join(f"{('email', 'ip', 'card', 'phone')[k]}:{s}:{e}" for s, k, e in spans)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert set(joined.split(",")) <= set(r["spans"].split(","))


def test_packed_sequences(spark, texts):
    check_packed(collected(spark, "op8").collect(), sorted(texts.items()), 1024)
    assert BYTE.endswith("byte_bpe_50k.json")


def test_fingerprints(spark, texts):
    rows = {r["doc_id"]: r for r in collected(spark, "op9").collect()}
    order = sorted(texts, reverse=True)
    for k, doc_id in enumerate(order):
        text, following = texts[doc_id], texts[order[(k + 1) % len(order)]]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        assert rows[doc_id]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert rows[doc_id]["n_chars"] == len(text)
