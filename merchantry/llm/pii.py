"""Personal data: fixed patterns as seeds, then contexts learned from them that find further identifiers."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchantry.llm.memory import lean
from merchantry.sources.shared import Scratch, written

KINDS = ("email", "ip", "card", "phone")
MIN_SEEDS = 5
ROUNDS = 3
CONFIDENT = 0.8
CONTEXT_CHARS = 80
SLICE = 100_000

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]")
_BLANK = re.compile(r"\s")
_NOT_DIGIT = re.compile(r"[^0-9]")
_NUMBER = re.compile(r"[+(]*[0-9][0-9().-]*")
_NEXT = re.compile(r"\x20\(?[0-9][0-9().-]*(?![^\s,;:!?])")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of local@domain from the left. Only the run of local characters before an @ can
    start one, which keeps the search linear in texts without any."""
    floor, at = 0, text.find("@")
    while at >= 0:
        before = text[floor:at]
        start = floor + len(before.rstrip(_LOCAL))
        floor = at + 1
        if start < at and (found := _DOMAIN.match(text, at + 1)):
            yield start, found.end()
            floor = found.end()
        at = text.find("@", floor)


def _is_ip(value: str) -> bool:
    return all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in value.split("."))


def luhn(digits: str) -> bool:
    """Whether the check digit is right: every second digit from the right counts double."""
    double = [d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2])]
    return (sum(double) + sum(map(int, digits[::-2]))) % 10 == 0


def _is_card(value: str) -> bool:
    digits = _NOT_DIGIT.sub("", value)
    return 14 <= len(digits) <= 19 and luhn(digits)


def _is_phone(value: str) -> bool:
    return 10 <= len(_NOT_DIGIT.sub("", value)) <= 15


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, by start, then kind. Failing matches are dropped."""
    found = [(s, 0, e) for s, e in _emails(text)]
    if _MARK.search(text):
        for kind, pattern, test in ((1, _IP, _is_ip), (2, _CARD, _is_card), (3, _PHONE, _is_phone)):
            found += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if test(m.group())]
    return sorted(found)


def _context(text: str, start: int) -> str:
    """The two words to the left, lower-cased."""
    return " ".join(text[max(0, start - CONTEXT_CHARS) : start].lower().split()[-2:])


def _number_row(text: str, start: int, end: int, limit: int) -> tuple[int, int]:
    """(end, digits) of the row of digit groups that begins with the token at start:end.

    Tokens of digits and their marks that single blanks join are one row; a comma, semicolon or
    full stop behind a token ends it. A token of another kind is a row without digits.
    """
    if not _NUMBER.fullmatch(text, start, end):
        return end, 0
    while text[end - 1] != "." and (more := _NEXT.match(text, end)) and more.end() <= limit:
        end = more.end()
    return end, len(_NOT_DIGIT.sub("", text[start:end]))


def candidates(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, bool]]:
    """(start, end, has @) of further tokens that look like identifiers: an @, or six digits or more,
    in one token or in groups of digits with single blanks between them, outside of every span.

    Groups are one number if they have 6 to 19 digits together. Longer rows of numbers are no
    identifier, so their tokens stand alone.
    """
    found, at, nearest = [], 0, 0
    ends = alone = 0
    while mark := _MARK.search(text, at):
        start = max(text.rfind(" ", at, mark.start()), text.rfind("\n", at, mark.start()), text.rfind("\t", at, mark.start())) + 1
        start = max(start, at)
        blank = _BLANK.search(text, mark.start())
        end = blank.start() if blank else len(text)
        while nearest < len(spans) and spans[nearest][0] < end:
            ends = max(ends, spans[nearest][2])
            nearest += 1
        if start >= max(ends, alone):
            row, digits = _number_row(text, start, end, spans[nearest][0] if nearest < len(spans) else len(text))
            if 6 <= digits <= 19:
                end = row
            else:
                alone = row
        at = end
        token = text[start:end]
        if start < ends or "@" not in token and sum(c in "0123456789" for c in token) < 6:
            continue
        left = len(token) - len(token.lstrip("\"'([{<,;:=")) if not _opens_number(token) else 0
        right = len(token.rstrip("\"')]}>,;:.!?"))
        if right - left >= 5:
            found.append((start + left, start + right, "@" in token))
    return found


def _opens_number(token: str) -> bool:
    """Whether the token starts with a bracket that a digit group closes, as in (555) 123-4567."""
    return token.startswith("(") and 0 < token.find(")") < len(token) - 1


def _found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        yield _found_in(texts)


def _found_masked(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """What `_found` gives, and the masked texts of rows whose spans are known without contexts."""
    for texts in batches:
        found = _found_in(texts)
        rows = zip(texts, found["base"], found["seen"], strict=True)
        new = [_masked(t, own) if len(own) == len(seen) else None for t, own, seen in rows]
        yield found.assign(masked=pd.Series(new, dtype=object))


def _found_in(texts: pd.Series) -> pd.DataFrame:
    spans, seen = [], []
    for text in texts.fillna(""):
        own = base_spans(text)
        spans.append([{"kind": k, "start": s, "end": e} for s, k, e in own])
        rows = [(k, s, e) for s, k, e in own] + [(4 + at, s, e) for s, e, at in candidates(text, own)]
        seen.append(
            [
                {
                    "kind": k, "start": s, "end": e, "context": _context(text, s),
                    "value": xxhash.xxh64_intdigest(text[s:e].lower()) >> 1,
                }
                for k, s, e in rows
            ]
        )
    return pd.DataFrame({"base": spans, "seen": seen})


_SPAN = "kind: int, start: int, end: int"
_FOUND = f"base array<struct<{_SPAN}>>, seen array<struct<{_SPAN}, context: string, value: bigint>>"


def _with_found(docs: DataFrame, masked: bool = False) -> DataFrame:
    task, kind = (_found_masked, f"{_FOUND}, masked string") if masked else (_found, _FOUND)
    # Spark moves filters on what a deterministic function returns below it and calls the function
    # for them once more, in a worker of its own
    found = F.pandas_udf(lean(task), kind).asNondeterministic()
    return docs.select(F.struct(*docs.columns).alias("row"), found("text").alias("found"))


def _occurrences_of(docs: DataFrame, contexts: DataFrame) -> DataFrame:
    """How often each context stands in the texts, whatever follows. The contexts go to the tasks
    in slices of bounded size; the texts are read once per slice."""
    spark = docs.sparkSession
    slices = -(-contexts.count() // SLICE)
    total = None
    for i in range(slices):
        own = contexts.where(F.pmod(F.xxhash64("context"), F.lit(slices)) == i).select("context").collect()
        shared = spark.sparkContext.broadcast(frozenset(r["context"] for r in own))

        def count(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            wanted = shared.value
            last = {c.rpartition(" ")[2] for c in wanted}
            for batch in batches:
                counts: Counter = Counter()
                for text in batch["text"].dropna():
                    words = text.lower().split()
                    for j, word in enumerate(words):
                        if word in last and (context := " ".join(words[max(0, j - 1) : j + 1])) in wanted:
                            counts[context] += 1
                yield pd.DataFrame(counts.items(), columns=["context", "n"])

        part = docs.select("text").mapInPandas(lean(count), "context string, n bigint")
        total = part if total is None else total.union(part)
    return total.groupBy("context").agg(F.sum("n").alias("total"))


def learn_contexts(docs: DataFrame) -> DataFrame:
    """(context, kind, score) of the contexts that announce an identifier with confidence.

    The seeds are the matches of the fixed patterns. A context is scored for a kind by the
    share of its distinct instances that are of the kind, weighed by their own scores, times
    the share of its appearances in all texts that an identifier follows. An instance that is
    no seed is scored by its contexts: one less the product of their doubts.

    Each of ROUNDS rounds first admits the contexts that at least MIN_SEEDS distinct trusted
    instances of a kind follow, then scores all admitted contexts and their instances. Trusted
    are the seeds and, from the second round on, instances with a score of CONFIDENT or more,
    so a context that no seed follows is found by identifiers that other contexts led to. Fewer
    sightings prove nothing. How often a context stands in the texts is counted in the round
    that admits it.
    """
    with Scratch(docs.sparkSession, "contexts") as scratch:
        return written(_learned(docs, scratch), "learned")


def _learned(docs: DataFrame, scratch: Scratch) -> DataFrame:
    seen = _with_found(docs).select(F.explode("found.seen").alias("s")).select("s.context", "s.value", "s.kind")
    edges = seen.where("context != ''").groupBy("context", "value", "kind").agg(F.count("*").alias("n"))
    edges = scratch.written(edges, "seen")
    shown = edges.groupBy("context").agg(F.sum("n").alias("shown"), F.countDistinct("value").alias("values"))
    # an unknown token with an @ may be an address, one without may be any of the other kinds
    possible = F.when(F.col("kind") < 4, F.array("kind")).when(
        F.col("kind") == 5, F.array(F.lit(0))
    ).otherwise(F.array(F.lit(1), F.lit(2), F.lit(3)))
    graph = edges.select("context", "value", F.explode(possible).alias("kind"), (F.col("kind") < 4).alias("seed"))
    graph = scratch.written(graph.groupBy("context", "value", "kind").agg(F.max("seed").alias("seed")), "graph")
    instances = graph.where("seed").select("value", "kind", F.lit(1.0).alias("weight")).distinct()
    measured = scores = None
    for _ in range(ROUNDS):
        trusted = instances.where(F.col("weight") >= CONFIDENT).select("value", "kind")
        admitted = graph.join(trusted, ["value", "kind"]).groupBy("context", "kind").agg(F.count("*").alias("trusted"))
        admitted = scratch.written(admitted.where(F.col("trusted") >= MIN_SEEDS).select("context", "kind"), "admitted")
        names = admitted.select("context").distinct()
        names = scratch.written(names.join(measured, "context", "left_anti") if measured else names, "names")
        if not names.isEmpty():
            follows = F.least(F.lit(1.0), F.col("shown") / F.col("total")).alias("follows")
            counted = shown.join(names, "context").join(_occurrences_of(docs, names), "context")
            counted = counted.select("context", "values", follows)
            measured = scratch.written(measured.union(counted) if measured else counted, "measured")
        elif measured is None:
            return admitted.select("context", "kind", F.lit(0.0).alias("score"))
        known = admitted.join(measured, "context")
        sums = graph.join(instances, ["value", "kind"]).groupBy("context", "kind").agg(F.sum("weight").alias("weight"))
        right = F.least(F.lit(1.0), F.col("weight") / F.col("values"))
        scores = known.join(sums, ["context", "kind"]).select("context", "kind", (right * F.col("follows")).alias("score"))
        scores = scratch.written(scores, "scores")
        doubts = F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.coalesce("score", F.lit(0.0))))))
        judged = graph.join(scores, ["context", "kind"], "left").groupBy("value", "kind").agg(
            F.when(F.max("seed"), 1.0).otherwise(1 - doubts).alias("weight")
        )
        instances = scratch.written(judged.where("weight > 0"), "instances")
    return scores.where(F.col("score") >= CONFIDENT)


def find_personal_data(docs: DataFrame) -> DataFrame:
    """The rows of `docs` with `base` and `spans`: arrays of (start, kind, end) by start, then kind.

    `base` are the matches of the fixed patterns, `spans` also those that learned contexts
    announce. The kind of an added span is that of its best context. Columns of `docs` come
    as the struct `row`, so their names cannot clash.

    Rows with no further token that looks like an identifier need no context and are passed on
    from the scan. The others are written with a number, joined with the contexts by their
    tokens, and put together again. A null or empty text has no spans.
    """
    plain, joined = _plain_and_joined(docs, _with_found(docs))
    base = _ordered(F.col("found.base"))
    return plain.select("row", base.alias("base"), base.alias("spans")).union(joined)


def _plain_and_joined(docs: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of `rows`, which `_with_found` gives for `docs`: those without unknown tokens as they are, and
    `row`, `base` and `spans` of the others."""
    contexts = learn_contexts(docs)
    unknown = F.filter("found.seen", lambda s: s["kind"] >= 4)
    rows = rows.withColumn("unknown", unknown)
    plain = rows.where(F.size("unknown") == 0).select("row", "found")
    hard = rows.where(F.size("unknown") > 0).select("row", "found.base", "unknown")
    hard = written(hard.withColumn("number", F.monotonically_increasing_id()), "tokens")
    tokens = hard.select("number", F.explode("unknown").alias("t")).select("number", "t.*")
    fits = ((F.col("kind") == 5) & (F.col("as_kind") == 0)) | ((F.col("kind") == 4) & (F.col("as_kind") > 0))
    named = contexts.select("context", F.col("kind").alias("as_kind"), "score")
    best = F.max_by("as_kind", F.struct("score", (-F.col("as_kind"))))
    added = tokens.join(named, "context").where(fits).groupBy("number", "start", "end").agg(best.alias("kind"))
    added = added.groupBy(F.col("number").alias("_number")).agg(
        F.collect_list(F.struct("kind", "start", "end")).alias("added")
    )
    joined = hard.join(added, F.col("number") == F.col("_number"), "left")
    every = F.concat("base", F.coalesce("added", F.array().cast(f"array<struct<{_SPAN}>>")))
    return plain, joined.select("row", _ordered(F.col("base")).alias("base"), _ordered(every).alias("spans"))


def _ordered(spans: Column) -> Column:
    return F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["kind"], s["end"])))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, numbers of fixed matches by kind, a digest of them, and all spans.

    Spans read kind:start:end, by start, then kind, joined by commas; positions are code points.
    """
    found = find_personal_data(docs)

    def number(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{KINDS[kind]}")

    counts = [number(kind) for kind in range(len(KINDS))]
    return found.select(
        F.col("row.doc_id").cast("bigint").alias("doc_id"),
        *counts,
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )


def mask_text(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span, overlapping ones taken together, replaced by its first kind in brackets."""
    out, at = [], 0
    for start, kind, end in sorted(spans):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _masked(text: str | None, spans: list[dict]) -> str | None:
    """The text with its spans replaced, or None if it has none."""
    return mask_text(text, [(s["start"], s["kind"], s["end"]) for s in spans]) if len(spans) else None


def masked(docs: DataFrame) -> DataFrame:
    """The rows of `docs` with personal data replaced in `text`; n_chars, if there, is that of the new text.

    Rows without a span come back unchanged, null texts too.
    """

    def mask(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([_masked(t, own) for t, own in zip(texts, spans, strict=True)], dtype=object)

    # no task calls more than one Python function, each of which takes a worker
    plain, joined = _plain_and_joined(docs, _with_found(docs, masked=True))
    own = F.pandas_udf(mask, "string")(F.col("row.text"), F.col("spans"))
    found = plain.select("row", "found.masked").union(joined.select("row", own.alias("masked")))
    columns = []
    for name, kind in docs.dtypes:
        value = F.col("row").getField(name)
        if name == "text":
            value = F.coalesce("masked", value)
        elif name == "n_chars":
            value = F.when(F.col("masked").isNull(), value).otherwise(F.length("masked").cast(kind))
        columns.append(value.alias(name))
    return found.select(*columns)


def digest(spans: list[tuple[int, int, int]]) -> str:
    """The digest of `report` for spans of one text, for checks."""
    return hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans)).encode()).hexdigest()
