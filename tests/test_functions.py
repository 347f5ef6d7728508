import json
import random
from datetime import date, datetime
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from merchantry.functions import documents
from merchantry.functions import scalar as s
from merchantry.functions.classify import class_rank, performance_tier, selectivity_level, velocity_category
from merchantry.functions.documents import is_malformed, merge_patch, row_image, without_members
from merchantry.rules import Rules


def value(spark, column):
    return spark.range(1).select(column).first()[0]


def test_time(spark):
    at = F.lit("2024-03-31 23:30:00").cast("timestamp_ntz")
    assert value(spark, s.before("2024-03-31", "1 month")) == datetime(2024, 2, 29)
    assert value(spark, s.days_since(at, "2024-04-01 00:10:00")) == 1
    assert value(spark, s.weekday_name(F.lit(date(2024, 3, 30)))) == "Saturday"
    assert [value(spark, s.is_weekend(F.lit(date(2024, 3, d)))) for d in (29, 30, 31)] == [False, True, True]
    assert value(spark, s.year_month(at)) == "2024-03"
    assert value(spark, s.age_years(F.lit(date(2000, 1, 1)), "2001-01-01")) == 1  # 366 days
    assert value(spark, s.age_years(F.lit(None).cast("date"), "2001-01-01")) is None


@pytest.mark.parametrize(
    ("first", "last", "months"),
    [("2024-01-31", "2024-02-29", 0), ("2024-01-15", "2024-02-15", 1), ("2024-01-15", "2025-01-14", 11), ("2024-05-05", "2024-05-05", 0)],
)
def test_whole_months(spark, first, last, months):
    assert value(spark, s.whole_months(F.lit(first).cast("date"), F.lit(last).cast("date"))) == months


def test_numbers(spark):
    assert value(spark, s.percent(F.lit(1), F.lit(8))) == D("12.50")
    assert value(spark, s.percent(F.lit(1), F.lit(3))) == D("33.33")
    assert value(spark, s.percent(F.lit(1), F.lit(0))) is None
    assert value(spark, s.mean_money(F.lit(D("0.25")), F.lit(2))) == D("0.13")
    assert value(spark, s.mean_money(F.lit(D("1.00")), F.lit(0))) is None
    assert value(spark, s.rate_or_zero(F.lit(1), F.lit(0))) == 0.0
    assert value(spark, s.rate_or_zero(F.lit(1), F.lit(4))) == 25.0
    assert value(spark, s.as_unsigned(F.lit("12"))) == 12
    assert value(spark, s.as_unsigned(F.lit("12x"))) is None


def test_text(spark):
    assert value(spark, s.full_name(F.lit("A"), F.lit(None).cast("string"))) is None
    assert value(spark, s.preview(F.lit("abcdef"), 3)) == "abc"
    assert value(spark, s.same_text(F.lit("JOSÉ@x.com")) == s.same_text(F.lit("jose@X.com")))


def test_bands(spark):
    steps = [(10, "high"), (5, "mid")]
    assert [value(spark, s.band(F.lit(v), steps, "low", strict=False)) for v in (10, 5, 4)] == ["high", "mid", "low"]
    assert [value(spark, s.band(F.lit(v), steps, "low", strict=True)) for v in (10, 5, 4)] == ["mid", "low", "low"]
    rules = Rules.reference()
    df = spark.createDataFrame([(D(v),) for v in ("999.99", "1000", "5000", "10000")], "total_revenue decimal(18,2)")
    assert [r[0] for r in df.select(performance_tier(rules)).collect()] == ["low", "medium", "high", "top"]
    speeds = [value(spark, velocity_category(rules, F.lit(v))) for v in (4.9, 5.0, 20.0, 50.0)]
    assert speeds == ["slow", "normal", "fast", "very_fast"]
    levels = [value(spark, selectivity_level(F.lit(v))) for v in (0, 9, 99, 100)]
    assert levels == ["No selectivity", "Low selectivity", "Medium selectivity", "High selectivity"]
    assert value(spark, class_rank(F.lit("b"), ["a", "b"])) == 2


def python_merge(target, patch):
    if not isinstance(patch, dict):
        return patch
    result = dict(target) if isinstance(target, dict) else {}
    for name, v in patch.items():
        if v is None:
            result.pop(name, None)
        else:
            result[name] = python_merge(result.get(name), v)
    return result


CASES = [
    ({"a": 1, "b": 2}, {"b": 3, "c": 4}),
    ({"a": 1, "b": 2}, {"b": None}),
    ({"a": None, "b": 2}, {"c": None}),
    ({"a": {"x": 1, "y": 2}}, {"a": {"y": None, "z": [1, {"q": None}]}}),
    ({"a": 5}, {"a": {"x": None, "y": {"z": None, "k": 1}}}),
    ({"a": {"x": 1}}, {"a": "text"}),
    ({"a": {"b": {"c": {"d": 1, "e": 2}}}}, {"a": {"b": {"c": {"d": None}}}}),
    ({"t": True, "f": 1.5, "s": "é\"q"}, {"t": False}),
    ({}, {"n": {}}),
    ({"n": {"a": 1}}, {"n": {}}),
]


def test_merge_patch_follows_the_rfc(spark):
    df = spark.createDataFrame([(json.dumps(o), json.dumps(p)) for o, p in CASES], "o string, p string")
    got = [json.loads(r[0]) for r in df.select(merge_patch("o", "p")).collect()]
    assert got == [python_merge(o, p) for o, p in CASES]


def random_value(rng, depth):
    kinds = ["int", "text", "bool", "null", "list"] + ["object"] * (2 if depth else 0)
    kind = rng.choice(kinds)
    if kind == "object":
        return {rng.choice("abcd"): random_value(rng, depth - 1) for _ in range(rng.randrange(4))}
    if kind == "list":
        return [random_value(rng, 0) for _ in range(rng.randrange(3))]
    return {"int": rng.randrange(-5, 10**12), "text": rng.choice(["", "é", 'q"', "x y"]), "bool": True, "null": None}[kind]


def test_merge_patch_agrees_with_brute_force(spark):
    rng = random.Random(3)
    cases = []
    while len(cases) < 400:
        pair = [random_value(rng, 4), random_value(rng, 4)]
        if all(isinstance(side, dict) for side in pair):
            cases.append(pair)
    df = spark.createDataFrame([tuple(json.dumps(side) for side in pair) for pair in cases], "o string, p string")
    got = [json.loads(r[0]) for r in df.select(merge_patch("o", "p")).collect()]
    assert got == [python_merge(o, p) for o, p in cases]


def test_merge_patch_with_missing_sides(spark):
    df = spark.createDataFrame([(None, '{"a": 1, "b": null}'), ('{"a": 1}', None), (None, None)], "o string, p string")
    assert [r[0] for r in df.select(merge_patch("o", "p")).collect()] == ['{"a":1}', '{"a": 1}', "{}"]


def nested(depth, value):
    for _ in range(depth):
        value = {"a": value}
    return value


RFC = [
    ('{"a":"b"}', '{"a":"c"}', '{"a":"c"}'),
    ('{"a":"b"}', '{"b":"c"}', '{"a":"b","b":"c"}'),
    ('{"a":"b"}', '{"a":null}', "{}"),
    ('{"a":"b","b":"c"}', '{"a":null}', '{"b":"c"}'),
    ('{"a":["b"]}', '{"a":"c"}', '{"a":"c"}'),
    ('{"a":"c"}', '{"a":["b"]}', '{"a":["b"]}'),
    ('{"a":{"b":"c"}}', '{"a":{"b":"d","c":null}}', '{"a":{"b":"d"}}'),
    ('{"a":[{"b":"c"}]}', '{"a":[1]}', '{"a":[1]}'),
    ('["a","b"]', '["c","d"]', '["c","d"]'),
    ('{"a":"b"}', '["c"]', '["c"]'),
    ('{"a":"foo"}', "null", "null"),
    ('{"a":"foo"}', '"bar"', '"bar"'),
    ('{"e":null}', '{"a":1}', '{"e":null,"a":1}'),
    ("[1,2]", '{"a":"b","c":null}', '{"a":"b"}'),
    ("{}", '{"a":{"bb":{"ccc":null}}}', '{"a":{"bb":{}}}'),
    # sides that are no objects, repeated members, text that is no JSON, exact numbers
    ('{"a":1}', "5", "5"),
    ("not json", '{"a":1}', '{"a":1}'),
    ('{"a":1}', "{broken", "{broken"),
    ('{"a":1,"a":2}', '{"b":3,"b":4}', '{"a":2,"b":4}'),
    ('{"n":1.10}', '{"m":12345678901234567890.123456789}', '{"n":1.10,"m":12345678901234567890.123456789}'),
]


def test_merge_patch_examples(spark):
    df = spark.createDataFrame([r[:2] for r in RFC], "o string, p string")
    assert [r[0] for r in df.select(merge_patch("o", "p")).collect()] == [r[2] for r in RFC]


def test_merge_patch_of_any_depth(spark):
    patch = json.dumps(nested(200, {"x": 1, "y": None}))
    df = spark.createDataFrame([(json.dumps(nested(200, {"y": 2, "z": 3})), patch)], "o string, p string")
    assert json.loads(df.select(merge_patch("o", "p")).first()[0]) == nested(200, {"x": 1, "z": 3})


def test_malformed_documents_are_kept_and_counted(spark):
    df = spark.createDataFrame([("{broken",), ("[1]",), ('{"a":1,"a":2}',), (None,)], "d string")
    cut = df.select(without_members("d", F.lit(["a"])), is_malformed("d"))
    assert [tuple(r) for r in cut.collect()][:2] == [("{broken", True), ("[1]", False)]
    assert [r[0] for r in cut.collect()][2:] == ["{}", None]


def test_images(spark):
    df = spark.createDataFrame([(1, None, D("2.50"))], "id int, name string, price decimal(18,2)")
    image = df.select(row_image(["id", "name", "price"]).alias("i"))
    assert json.loads(image.first()[0]) == {"id": 1, "name": None, "price": 2.5}
    cut = image.select(without_members("i", F.lit(["name", "other"])), without_members("i", F.lit(None).cast("array<string>")))
    assert json.loads(cut.first()[0]) == {"id": 1, "price": 2.5}
    assert json.loads(cut.first()[1]) == {"id": 1, "name": None, "price": 2.5}


def test_rules():
    assert Rules.from_mapping({"vip_above_spent": 7}).vip_above_spent == 7
    with pytest.raises(ValueError, match="unknown"):
        Rules.from_mapping({"nope": 1})


@pytest.mark.parametrize("depth", [500, 5_000, 50_000])
def test_json_of_any_depth(spark, depth):
    def nested(inner, empty='"x":[]'):
        return '{"a":' * depth + inner + (f",{empty}}}" if empty else "}") * depth

    document, patch = nested('{"keep":1.50,"go":2}'), nested('{"go":null,"new":[{}]}', "")
    wanted = nested('{"keep":1.50,"new":[{}]}')
    lists = "[" * depth + "]" * depth
    rows = [(document, patch), (lists, patch), (document, lists), (document, None), ("[" * depth, '{"a":1}'), (patch + "}", "{}")]
    df = spark.createDataFrame(rows, "d string, p string")
    bare = nested('{"new":[{}]}', "")
    got = [r[0] for r in df.select(merge_patch("d", "p")).collect()]
    assert got == [wanted, bare, lists, document, '{"a":1}', "{}"]
    stripped = spark.createDataFrame([(document,), (lists,)], "d string").withColumn("n", F.array(F.lit("x")))
    assert [r[0] for r in stripped.select(without_members("d", "n")).collect()] == [document[: -len(',"x":[]}')] + "}", lists]


def test_half_surrogate_pairs_stay_escapes(spark):
    df = spark.createDataFrame([(r'{"a":"\ud800","b":"\ud83d\ude00é"}', r'{"\udc00":1}')], "d string, p string")
    assert df.select(merge_patch("d", "p")).first()[0] == r'{"a":"\ud800","b":"😀é","\udc00":1}'


@pytest.mark.parametrize("text", ['{"a":[1,-2.5e3,true,null,"x\\n"],"a":{},"b":[[],{}]}', "[1,]", "{1:2}", '{"a" 1}', "01", "[1 2]", "nul", '"', ""])
def test_the_parser_for_deep_texts_equals_the_standard_one(text):
    def outcome(parse):
        try:
            return parse(text)
        except ValueError:
            return "none"

    assert outcome(documents._parsed_deep) == outcome(documents._parsed)
