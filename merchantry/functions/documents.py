"""JSON images: build them from columns, drop members, merge a patch into a document."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from json.decoder import scanstring

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from merchantry.functions.scalar import col


def row_image(columns: Sequence[str | Column]) -> Column:
    """A JSON object of the columns; NULL columns stay as null members."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def string_list(*values: str) -> Column:
    return F.array(*[F.lit(v) for v in values])


class _Number(str):
    """A JSON number as it was written."""


class _Text(str):
    """Output that is ready, among values still to be written."""


_SPACE = re.compile(r"[ \t\n\r]*")
_NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")
_WORDS = {"true": True, "false": False, "null": None}
_SURROGATE = re.compile("[\ud800-\udfff]")


def _parsed(text: str):
    """The value of a JSON text; of repeated members the last counts. ValueError if it is none."""
    try:
        return json.loads(text, parse_int=_Number, parse_float=_Number, parse_constant=_rejected)
    except RecursionError:
        return _parsed_deep(text)


def _rejected(name: str):
    raise ValueError(name)


def _string_at(text: str, at: int) -> tuple[str, int]:
    if text[at : at + 1] != '"':
        raise ValueError("a string is missing")
    return scanstring(text, at + 1, True)


def _scalar_at(text: str, at: int) -> tuple[object, int]:
    if text[at : at + 1] == '"':
        return _string_at(text, at)
    if number := _NUMBER.match(text, at):
        return _Number(number[0]), number.end()
    for word, value in _WORDS.items():
        if text.startswith(word, at):
            return value, at + len(word)
    raise ValueError("a value is missing")


def _parsed_deep(text: str):
    """The same for texts nested too deep for the standard parser, with a stack of its own."""
    whole: list = []
    open_: list = [whole]  # the containers around a place
    names: list[str] = []  # the member that each open object has begun

    def name_at(at: int) -> int:
        name, at = _string_at(text, _SPACE.match(text, at).end())
        at = _SPACE.match(text, at).end()
        if text[at : at + 1] != ":":
            raise ValueError("a colon is missing")
        names.append(name)
        return at + 1

    def put(value) -> None:
        if isinstance(open_[-1], dict):
            open_[-1][names.pop()] = value
        else:
            open_[-1].append(value)

    at = 0
    while True:
        at = _SPACE.match(text, at).end()
        if (c := text[at : at + 1]) in ("{", "["):
            value, closing = ({}, "}") if c == "{" else ([], "]")
            put(value)
            at = _SPACE.match(text, at + 1).end()
            if text[at : at + 1] != closing:
                open_.append(value)
                at = name_at(at) if c == "{" else at
                continue
            at += 1
        else:
            value, at = _scalar_at(text, at)
            put(value)
        while True:  # behind a value: the next one, or the end of what is open
            at = _SPACE.match(text, at).end()
            if len(open_) == 1:
                if at < len(text):
                    raise ValueError("something follows")
                return whole[0]
            inside = open_[-1]
            if text[at : at + 1] == ",":
                at = name_at(at + 1) if isinstance(inside, dict) else at + 1
                break
            if text[at : at + 1] != ("}" if isinstance(inside, dict) else "]"):
                raise ValueError("a container is open")
            open_.pop()
            at += 1


def _quoted(text: str) -> str:
    """A JSON string; half a surrogate pair, which no UTF-8 text holds, stays an escape."""
    return json.dumps(text, ensure_ascii=bool(_SURROGATE.search(text)))


def _rendered(value) -> str:
    out, waiting = [], [value]
    while waiting:
        item = waiting.pop()
        if isinstance(item, _Text | _Number):
            out.append(item)
        elif isinstance(item, dict):
            parts: list = []
            for name, member in item.items():
                parts += [_Text(f"{',' if parts else '{'}{_quoted(name)}:"), member]
            waiting += [_Text("}" if parts else "{}"), *reversed(parts)]
        elif isinstance(item, list):
            parts = []
            for member in item:
                parts += [_Text("," if parts else "["), member]
            waiting += [_Text("]" if parts else "[]"), *reversed(parts)]
        else:
            out.append(_quoted(item) if isinstance(item, str) else json.dumps(item))
    return "".join(out)


def _patched(document, patch):
    """The merge of RFC 7396, level by level."""
    if not isinstance(patch, dict):
        return patch
    merged = dict(document) if isinstance(document, dict) else {}
    waiting = [(merged, patch)]
    while waiting:
        target, change = waiting.pop()
        for name, value in change.items():
            if value is None:
                target.pop(name, None)
            elif isinstance(value, dict):
                old = target.get(name)
                target[name] = dict(old) if isinstance(old, dict) else {}
                waiting.append((target[name], value))
            else:
                target[name] = value
    return merged


def merged_text(document: str | None, patch: str | None) -> str | None:
    """A patch merged into a document, both as JSON text.

    Without a patch the document stays, without a document the patch applies to an empty one.
    A patch that is no object replaces the document, as does one that is no JSON at all; a
    document that is no object, or no JSON, counts as empty.
    """
    if patch is None:
        return "{}" if document is None else document
    try:
        change = _parsed(patch)
    except ValueError:
        return patch
    try:
        old = _parsed(document) if document is not None else {}
    except ValueError:
        old = {}
    return _rendered(_patched(old, change))


def stripped_text(document: str | None, names: Sequence[str] | None) -> str | None:
    """A JSON object without some members; any other text comes back as it is."""
    if document is None or names is None:
        return document
    try:
        members = _parsed(document)
    except ValueError:
        return document
    if not isinstance(members, dict):
        return document
    return _rendered({k: v for k, v in members.items() if k not in set(names)})


def is_malformed(document: str | Column) -> Column:
    """Whether a text is present and no JSON, for counting what a merge could only keep as it is."""
    return col(document).isNotNull() & F.try_parse_json(col(document)).isNull()


def without_members(document: str | Column, names: str | Column) -> Column:
    """The JSON object without the members named in an array column; a NULL list drops none."""

    def strip(documents: pd.Series, lists: pd.Series) -> pd.Series:
        return pd.Series([stripped_text(d, n) for d, n in zip(documents, lists, strict=True)], dtype=object)

    return F.pandas_udf(strip, "string")(col(document), col(names))


def merge_patch(document: str | Column, patch: str | Column) -> Column:
    """RFC 7396 merge of JSON texts of any depth; see `merged_text` for texts that are no objects.

    The merge goes as deep as its input, which no built-in expression can, so it runs on Arrow
    batches in Python, with stacks of its own, so that no depth ends the job. Numbers keep the digits they were written with.
    """

    def merge(documents: pd.Series, patches: pd.Series) -> pd.Series:
        return pd.Series([merged_text(d, p) for d, p in zip(documents, patches, strict=True)], dtype=object)

    return F.pandas_udf(merge, "string")(col(document), col(patch))
