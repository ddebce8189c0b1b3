"""Tolerant equality of two JSON values.

Values travel as JSON text, null and JSON null both standing for no value. The
order of the rules matters: equal, null, number, date, container, text. All rules
are column expressions. A pair of containers is flattened on both sides to leaves
(path, container mark, value), texts that hold a container included; the sides
match if they have the same paths with the same marks and the values of each path
match by the rules for scalars. Only the flattening, a reading of JSON as a
stream, runs in Python, and only for pairs of containers.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions import jsontext
from ledgerloom.functions.normalize import is_container, is_text, parse_date, parse_number, same_text, scalar_text, strip

TOLERANCE = 1e-6


def no_value(value: Column) -> Column:
    return value.isNull() | (strip(value) == "null")


def number_of(value: Column) -> Column:
    """S4 on JSON text: booleans count as numbers."""
    text = scalar_text(value)
    return F.when(is_container(value), F.lit(None).cast("double")).when(strip(value) == "true", 1.0).when(strip(value) == "false", 0.0).otherwise(parse_number(text))


def date_of(value: Column) -> Column:
    """S6 on JSON text: only strings that are not all digits."""
    text = scalar_text(value)
    return F.when(is_text(value) & ~strip(text).rlike(r"^\p{Nd}+$"), parse_date(text))


def holds_container(value: Column) -> Column:
    return is_container(value) | (is_text(value) & strip(scalar_text(value)).rlike(r"^[\[{]"))


def scalars_match(a: Column, b: Column) -> Column:
    """S1 for values of which at most one is a container."""
    x, y = number_of(a), number_of(b)
    d, e = date_of(a), date_of(b)
    return (
        F.when(no_value(a) | no_value(b), no_value(a) & no_value(b))
        .when(strip(a) == strip(b), True)
        .when(x.isNotNull() & y.isNotNull(), F.abs(x - y) <= TOLERANCE)
        .when(d.isNotNull() & e.isNotNull(), d == e)
        .when(is_text(a) & is_text(b), same_text(scalar_text(a), scalar_text(b)))
        .otherwise(False)
    )


def values_match(a: Column, b: Column) -> Column:
    """S1 for any two JSON values; the flattening sees pairs of containers only."""
    both = holds_container(a) & holds_container(b) & ~(no_value(a) | no_value(b))
    return F.when(both, containers_match(F.when(both, a), F.when(both, b))).otherwise(scalars_match(a, b))


def containers_match(a: Column, b: Column) -> Column:
    """S8, S9 and U4 for two containers: equal paths and marks, and matching values under each path."""
    pairs = open_pairs(a, b)
    return F.coalesce(F.forall(pairs, lambda x: F.coalesce(scalars_match(x["one"], x["two"]), F.lit(False))), F.lit(False))


PAIRS = T.ArrayType(T.StructType([T.StructField("one", T.StringType()), T.StructField("two", T.StringType())]))


@F.pandas_udf(PAIRS)
def open_pairs(a: pd.Series, b: pd.Series) -> pd.Series:
    """The values that stand under equal paths and aren't written alike; null where the sides' paths or marks differ."""

    def paired(one: str | None, two: str | None):
        if one is None or two is None:
            return None
        left, right = flattened(one), flattened(two)
        if left.keys() != right.keys():
            return None
        pairs = []
        for path, (mark, value) in left.items():
            other_mark, other = right[path]
            if mark != other_mark:
                return None
            if value != other:
                pairs.append({"one": value, "two": other})
        return pairs

    return pd.Series([paired(x, y) for x, y in zip(a, b, strict=True)], dtype=object)


def flattened(text: str) -> dict[str, tuple[str, str]]:
    """The leaves of a JSON value, path to (mark, value). Opening marks are leaves too, so that empty containers and kinds of containers count.

    A path is a list of keys and positions, each behind a mark that tells both apart. Of a repeated key the last value counts.
    A text that isn't JSON is one leaf.
    """
    found: dict[str, tuple[str, str]] = {}
    try:
        walk(text, "", found)
    except ValueError:
        return {"": ("", json.dumps(text, ensure_ascii=False))}
    return found


def walk(text: str, root: str, found: dict[str, tuple[str, str]]) -> None:
    """Puts the leaves of `text` into `found`; texts that hold containers are read in turn, each by its own stream."""
    todo = [(root, text)]
    while todo:
        path, source = todo.pop()
        try:
            own = stream_leaves(source, path)
        except ValueError:
            if path == root:
                raise
            found[path] = ("", json.dumps(source, ensure_ascii=False))
            continue
        for p, (mark, value) in own.items():
            found[p] = (mark, value)
            if mark == "" and value[:1] == '"':
                inner = json.loads(value)
                if inner.strip()[:1] in ("[", "{") and inner.strip():
                    todo.append((p, inner.strip()))


def stream_leaves(text: str, path: str) -> dict[str, tuple[str, str]]:
    """The leaves of one JSON text, texts within it unread: path to (mark, JSON of the value)."""
    found: dict[str, tuple[str, str]] = {}
    open_: list[list] = []  # per open container: its path, its mark, the next position, the keys seen
    here = path
    for kind, content in jsontext.events(text):
        if kind == jsontext.KEY_EVENT:
            top = open_[-1]
            here = f"{top[0]}.{content.replace('~', '~0').replace('.', '~1').replace('#', '~2')}"
            if here in top[3]:
                for p in [p for p in found if p == here or p.startswith((here + ".", here + "#"))]:
                    del found[p]
            top[3].add(here)
            continue
        if kind == jsontext.CLOSE:
            open_.pop()
            continue
        if open_ and open_[-1][1] == "[":
            here = f"{open_[-1][0]}#{open_[-1][2]}"
            open_[-1][2] += 1
        if kind == jsontext.OPEN:
            found[here] = (content, "")
            open_.append([here, content, 0, set()])
        else:
            found[here] = ("", json.dumps(content, ensure_ascii=False) if kind == jsontext.TEXT else content)
    return found
