"""Personal data: the fixed patterns against plain regular expressions, learned contexts, masking."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from merchantry.llm import pii
from tests.llm.edge import documents, empty

PLAIN = [
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"),
    re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def passes_luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain_spans(text):
    found = []
    for kind, pattern in enumerate(PLAIN):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            good = (
                kind == 0
                or (kind == 1 and all(int(p) <= 255 for p in m.group().split(".")))
                or (kind == 2 and 14 <= len(digits) <= 19 and passes_luhn(digits))
                or (kind == 3 and 10 <= len(digits) <= 15)
            )
            if good:
                found.append((m.start(), kind, m.end()))
    return sorted(found)


@settings(max_examples=1500, deadline=None)
@given(st.text(st.sampled_from(list("a1.@+ -()9b5%_2é")), max_size=50))
def test_base_spans_equal_plain_patterns(text):
    assert pii.base_spans(text) == plain_spans(text)


@pytest.mark.parametrize("text", ["a" * 200_000, "@" * 100_000, "1" * 200_000, "1." * 100_000, "+1 " * 60_000, "a.b@" * 50_000])
def test_long_runs_take_linear_time(text):
    pii.base_spans(text)
    pii.candidates(text, [])


def seeded():
    """Contact lines whose numbers match, one whose number has too few digits, and such a number elsewhere."""
    rows = [(i, f"some words here call me +1 (555) 010-{1000 + i} thanks") for i in range(8)]
    rows += [(20, "please call me 555-0199 today"), (21, "the order had 555-0199 parts in it"), (22, "no data")]
    rows += [(i, f"call it a day {i}") for i in range(30, 40)]
    return rows


def test_learned_contexts_add_spans_and_keep_the_fixed_ones(spark):
    got = {r["doc_id"]: r for r in pii.report(documents(spark, seeded())).collect()}
    text = dict(seeded())
    for doc_id, row in got.items():
        joined = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in plain_spans(text[doc_id]))
        assert row["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
    at = text[20].index("555-0199")
    assert got[20]["spans"] == f"phone:{at}:{at + 8}"
    assert [got[i]["spans"] for i in (21, 22, 30)] == ["", "", ""]
    assert got[0]["n_phone"] == 1 and got[20]["n_phone"] == 0


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ("call 555 123 4567 now", ["555 123 4567"]),
        ("call (555) 123-4567.", ["(555) 123-4567"]),
        ("card 4111 1111 1111 1112, thanks", ["4111 1111 1111 1112"]),
        ("in 12 345 678, 90 of them", ["12 345 678"]),
        ("ended 2020. 2021 was", []),
        ("12 34 and 56", []),
        ("rows 1111 2222 3333 4444 5555 6666", []),
        ("rows 111111 222222 333333 444444", ["111111", "222222", "333333", "444444"]),
        ("555 123 +1 555 010 1234", ["555 123"]),
        ("id AB123456 555", ["AB123456"]),
        ("(ref 123456)", ["123456"]),
        ("x 123\n456 789\n", ["456 789"]),
        ("joe@host 12 34", ["joe@host"]),
    ],
)
def test_candidates_join_groups_of_digits(text, wanted):
    assert [text[s:e] for s, e, _ in pii.candidates(text, pii.base_spans(text))] == wanted


def learned_by_hand(rows):
    """The contexts of `learn_contexts` from plain dictionaries."""
    seen, words_before = [], []
    for _, text in rows:
        own = pii.base_spans(text)
        found = [(s, e, [k], True) for s, k, e in own]
        found += [(s, e, [0] if at else [1, 2, 3], False) for s, e, at in pii.candidates(text, own)]
        seen += [(" ".join(text[:s].lower().split()[-2:]), text[s:e].lower(), k, seed) for s, e, k, seed in found]
        words = text.lower().split()
        words_before += [" ".join(words[max(0, j - 1) : j + 1]) for j in range(len(words))]
    seen = [x for x in seen if x[0]]
    weight = {(v, kind): 1.0 for _, v, kinds, seed in seen if seed for kind in kinds}
    edges = {(c, v, kind) for c, v, kinds, _ in seen for kind in kinds}
    seeds = set(weight)
    for _ in range(pii.ROUNDS):
        scores = {}
        for c, kind in {(c, kind) for c, _, kind in edges}:
            own = [v for c2, v, k2 in edges if (c2, k2) == (c, kind)]
            if sum(weight.get((v, kind), 0) >= pii.CONFIDENT for v in own) < pii.MIN_SEEDS:
                continue
            values = len({v for c2, v, _, _ in seen if c2 == c})
            follows = min(1, sum(c2 == c for c2, *_ in seen) / words_before.count(c))
            scores[c, kind] = min(1, sum(weight.get((v, kind), 0) for v in own) / values) * follows
        doubt = {}
        for c, v, kind in edges:
            doubt[v, kind] = doubt.get((v, kind), 1.0) * max(1e-9, 1 - scores.get((c, kind), 0))
        weight = {key: 1.0 if key in seeds else 1 - d for key, d in doubt.items()}
    return {key: score for key, score in scores.items() if score >= pii.CONFIDENT}


def bootstrapped():
    """Numbers that no fixed pattern matches: ten after a context with seeds, the same after one
    without any, and others after that one alone; and numbers that are no personal data."""
    seeds = [(i, f"you can reach me at +1 555 {i:03d} 4567 today") for i in range(40)]
    first = [(100 + i, f"you can reach me at 555 {200 + i} 4567 today") for i in range(8)]
    second = [(200 + i, f"the desk line: 555 {200 + i} 4567 rings") for i in range(8)]
    third = [(300 + i, f"the desk line: 555 {310 + i} 9876 rings") for i in range(2)]
    other = [(400 + i, f"the sum was 555 {i:03d} 4567 in all") for i in range(200, 230)]
    return [*seeds, *first, *second, *third, *other]


def test_contexts_found_by_learned_instances_equal_a_plain_count(spark):
    rows = bootstrapped()
    got = {(r["context"], r["kind"]): r["score"] for r in pii.learn_contexts(documents(spark, rows)).collect()}
    wanted = learned_by_hand(rows)
    assert got == pytest.approx(wanted)
    assert {("me at", 3), ("desk line:", 3)} <= set(got)
    found = {r["doc_id"]: r["spans"] for r in pii.report(documents(spark, rows)).collect()}
    added = {i for i, spans in found.items() if spans and i >= 100}
    assert added == {i for i, _ in rows if 100 <= i < 400}  # all of them, and nothing else
    text = dict(rows)[300]
    at = text.index("555")
    assert found[300] == f"phone:{at}:{at + 12}"


def test_a_context_that_also_stands_elsewhere_proves_nothing(spark):
    rows = seeded() + [(i, "they call me names") for i in range(100, 140)]
    got = {r["doc_id"]: r["spans"] for r in pii.report(documents(spark, rows)).collect()}
    assert got[20] == "" and got[0] != ""


def test_edge_rows_and_nothing(spark):
    df = documents(spark)
    got = pii.report(df).collect()
    assert len(got) == df.count()
    assert sorted((r["doc_id"] for r in got), key=repr) == sorted((r["doc_id"] for r in df.collect()), key=repr)
    assert pii.report(empty(spark)).count() == 0


def test_masked_changes_only_what_holds_data(spark):
    rows = [*seeded(), (None, "write to a.b@mail.example.com, or +1 555 010 1234"), (50, None), (51, "")]
    df = documents(spark, rows)
    out = pii.masked(df)
    assert out.dtypes == df.dtypes
    got = {(r["doc_id"], r["row"]): r for r in out.collect()}
    assert got[None, "x"]["text"] == "write to [EMAIL], or [PHONE]"
    assert got[None, "x"]["n_chars"] == len("write to [EMAIL], or [PHONE]")
    assert got[20, "x"]["text"] == "please call me [PHONE] today"
    assert got[22, "x"]["text"] == "no data" and got[50, "x"]["text"] is None and got[51, "x"]["text"] == ""
    assert out.count() == len(rows)


def test_no_task_calls_two_python_functions(spark):
    rows = [(i, f"mail to user{i}@example.org or call 555 0100 {i:04d} now") for i in range(20)]
    df = documents(spark, [*rows, (20, "nothing here"), (21, None)])
    for out, branches in ((pii.masked(df), 2), (pii.find_personal_data(df), 1)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == branches  # one in each branch of the union that has any


def test_mask_text_joins_overlaps():
    assert pii.mask_text("ab 1234 cd", [(3, 2, 7), (4, 3, 9)]) == "ab [CARD]d"
