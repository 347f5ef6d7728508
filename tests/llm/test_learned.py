"""Language, quality and licence models: held-out accuracy, definitions and edge cases."""

import textwrap
import zlib

import numpy as np
import pytest

from merchantry.llm import language, licences, quality
from tests.llm.edge import documents, empty

DIRECTORY = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet(f"{DIRECTORY}/documents.parquet")


@pytest.fixture(scope="module")
def languages(corpus):
    return language.train(corpus)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{DIRECTORY}/labels.parquet")


@pytest.fixture(scope="module")
def fitted(corpus, labels):
    return quality.train(corpus, labels)


@pytest.fixture(scope="module")
def notices(corpus):
    return licences.train(corpus)


def test_language_of_held_out_documents(corpus, languages):
    truth = {r["doc_id"]: r["lang"] for r in corpus.collect()}
    rows = [r for r in language.identify(corpus, languages).collect() if r["held_out"]]
    assert {r["doc_id"] for r in rows} == {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in rows]) > 0.98


def test_words_come_first_and_backoff_gets_shorter():
    def table(**entries):
        return {k: np.log(np.array(v)) for k, v in entries.items()}

    tables = [table(known=(0.9, 0.1)), {}, table(ab=(0.2, 0.8)), table(abc=(0.7, 0.3)), table(zzzz=(0.5, 0.5))]
    model = language.LanguageModel(["aa", "bb"], np.zeros(2), tables)
    known, three, two, none = model.evidence(["known", "xabcx", "xabx", "qqq"])
    assert np.allclose(known, [*np.log([0.9, 0.1]), 1])
    assert np.allclose(three, [*np.log([0.7, 0.3]), 1])  # three letters before two
    assert np.allclose(two, [*np.log([0.2, 0.8]), 1])
    assert not none.any()
    assert model.predict("known known") == ("aa", pytest.approx(0.81 / 0.82))
    assert model.predict("qqq known")[1] == pytest.approx(0.45)
    assert model.predict("qqq") == ("aa", 0.0)
    assert model.predict("12 !") == model.predict(None) == model.predict("") == ("und", 0.0)


def test_any_number_of_languages_is_learned(spark):
    """Of 300 languages with a word of their own, one far larger than the others, none is left out."""
    name = lambda i: f"{chr(97 + i // 26)}{chr(97 + i % 26)}q"
    rows = [(i, f"{name(i % 300)} shared " * 3, f"l{i % 300}") for i in range(6000)]
    rows += [(10_000 + i, " ".join(f"{name(k)}{name(i)}" for k in range(40)), "big") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language.train(docs, max_entries=50)
    assert len(model.languages) == 301
    assert all(model.predict(name(i))[0] == f"l{i}" for i in range(300))
    words = model._at[0]
    assert 300 < len(words) <= 300 + 1 + 50


def test_entries_equal_the_smoothed_frequencies(spark):
    docs = spark.createDataFrame(
        [(1, "ab ab cd", "x"), (3, "cd", "y"), (4, "cd ef", "y")], "doc_id bigint, text string, lang string"
    )
    usable = [r for r in docs.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2]
    model = language.train(docs)
    langs = sorted({r["lang"] for r in usable})
    counts = {lang: [w for r in usable if r["lang"] == lang for w in r["text"].split()] for lang in langs}
    vocabulary = {w for words in counts.values() for w in words}
    for word in vocabulary:
        logs = [np.log((counts[k].count(word) + 0.5) / (len(counts[k]) + 0.5 * len(vocabulary))) for k in langs]
        assert np.allclose(model.evidence([word])[0, :-1], logs)


def test_long_texts_do_not_outgrow_the_memory(monkeypatch):
    monkeypatch.setattr(language, "MEMORY", 40)
    monkeypatch.setattr(language, "PART", 30)
    tables = [{}, {"a": np.log(np.array([0.6, 0.4]))}, {}, {}, {}]
    model = language.LanguageModel(["x", "y"], np.zeros(2), tables)
    text = " ".join("a" * (1 + i % 200) for i in range(2000))
    assert model.predict(text)[0] == "x"


def test_language_edges(spark, corpus, languages):
    df = documents(spark)
    rows = language.identify(df, languages).collect()
    assert len(rows) == df.count()
    by_id = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert [by_id[i]["lang_pred"] for i in (3, 4, 5, 10)] == ["und"] * 4
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert language.identify(empty(spark), languages).count() == 0
    nothing = language.train(empty(spark))
    assert {r["lang_pred"] for r in language.identify(df, nothing).collect()} == {"und"}


def test_quality_of_held_out_documents(corpus, labels, fitted):
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = [r for r in quality.score_documents(corpus, fitted).collect() if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in rows]) > 0.95
    good = [r["score"] for r in rows if truth[r["doc_id"]] == 1]
    bad = [r["score"] for r in rows if truth[r["doc_id"]] == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.97


def test_identity_equals_the_sum_over_pairs():
    rng = np.random.default_rng(4)
    model = quality.QualityModel(0.3, rng.normal(size=quality.FEATURES), rng.normal(size=(quality.FEATURES, 4)), None)
    rows = [(np.array([1, 5, 9]), np.array([0.5, 1.0, 2.0])), (np.array([7]), np.array([1.5]))]
    for (at, x), score in zip(rows, model.score(rows), strict=True):
        total = 0.3 + (model.weights[at] * x).sum()
        for i in range(len(at)):
            for j in range(i):
                total += model.factors[at[i]] @ model.factors[at[j]] * x[i] * x[j]
        assert score == pytest.approx(1 / (1 + np.exp(-total)))


def test_quality_edges(spark, labels, fitted):
    df = documents(spark)
    rows = quality.score_documents(df, fitted).collect()
    assert len(rows) == df.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    assert quality.score_documents(df.drop("n_chars"), fitted).count() == df.count()
    assert quality.score_documents(empty(spark), fitted).count() == 0
    untrained = quality.train(empty(spark), labels)
    assert {r["score"] for r in quality.score_documents(df, untrained).collect()} == {0.5}


def test_signs_for_numbers_are_no_letters():
    assert language.words_of("½ ² Ⅷ ① 10 _") == []
    assert language.words_of("Œuvre½x 中文 Ⅷe") == ["œuvre", "x", "中文", "e"]



def test_licences_of_the_corpus(corpus, notices):
    names = {"MIT License": "MIT", "Apache License": "Apache-2.0", "GNU General": "GPL-3.0", "CC BY-NC": "CC-BY-NC-4.0"}
    text = {r["doc_id"]: r["text"].lower() for r in corpus.collect()}
    for r in licences.scan_licences(corpus, notices).collect():
        wanted = sorted(family for name, family in names.items() if name.lower() in text[r["doc_id"]])
        assert r["licences"] == ",".join(wanted)


def test_licences_in_lines_and_close_calls(spark, notices):
    filler = " ".join(f"filler{i}" for i in range(300))
    apache = "Licensed under the Apache License, Version 2.0."
    rows = [
        (1, f"{filler} {apache} {filler}"),
        (2, f"first line\n{apache.upper()}\nReleased under the MIT License."),
        (3, "he was licensed under the old rules"),
        (4, "This is a work of fiction, free of charge."),
        (5, "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
        (6, "This work is licensed under the GNU General Public License, version 3."),
    ]
    got = {r["doc_id"]: r["licences"] for r in licences.scan_licences(documents(spark, rows), notices).collect()}
    assert got == {1: "Apache-2.0", 2: "Apache-2.0,MIT", 3: "", 4: "", 5: "CC-BY-SA-4.0", 6: "GPL-3.0"}


def test_every_template_is_recognised(spark, notices):
    rows = [(i, text) for i, (_, text) in enumerate(licences.TEMPLATES)]
    got = {r["doc_id"]: r["licences"] for r in licences.scan_licences(documents(spark, rows), notices).collect()}
    assert got == {i: family for i, (family, _) in enumerate(licences.TEMPLATES)}


@pytest.mark.parametrize("mark", ["", " * ", "# ", "// "])
def test_wrapped_templates_are_recognised(spark, notices, mark):
    rows = []
    for i, (_, text) in enumerate(licences.TEMPLATES):
        wrapped = "\n".join(mark + line for line in textwrap.wrap(text, 72))
        rows.append((i, f"{mark}A file of some project\n{mark}\n{wrapped}\n{mark}\nint main();"))
    got = {r["doc_id"]: (r["licences"], r["n_notices"]) for r in licences.scan_licences(documents(spark, rows), notices).collect()}
    assert got == {i: (family, 1) for i, (family, _) in enumerate(licences.TEMPLATES)}


def test_two_notices_in_one_paragraph(spark, notices):
    rows, wanted = [], {}
    for family, text in licences.TEMPLATES:
        for other, second in licences.TEMPLATES:
            if family < other and len(f"{text} {second}".split()) <= licences.MAX_WORDS:
                wanted[len(rows)] = f"{family},{other}"
                rows.append((len(rows), f"{text} {second}"))
    got = {r["doc_id"]: r["licences"] for r in licences.scan_licences(documents(spark, rows), notices).collect()}
    assert {i: got[i] for i in wanted if got[i] != wanted[i]} == {}


def test_licence_edges(spark, notices):
    df = documents(spark)
    rows = licences.scan_licences(df, notices).collect()
    assert len(rows) == df.count()
    assert {(r["licences"], r["n_notices"], r["probability"], r["similarity"]) for r in rows} == {("", 0, 0.0, 0.0)}
    assert licences.scan_licences(empty(spark), notices).count() == 0
    assert licences.scan_licences(df, licences.train(empty(spark))).count() == df.count()
