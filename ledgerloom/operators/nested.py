"""Nested records as flat, linked tables (problem 3).

Every record is read as a stream of events and turned into path-value-ordinal
triples on the way; no tree of it is built and the reader keeps its own stack, so
that nesting has no depth limit. The triples are grouped by their repeated
ancestor, the list whose entry they belong to, and each group is pivoted into a
table: a row per entry, with the path of its parent. What stands outside of all
lists makes the table of records.

A list may be written as an array, as an object with counting keys, as a lone
object, or as any of these encoded as JSON text; all are read alike. Which members
are lists is told by their names; without names every array is one whose first
entry is an object.

Defined results: null, blank or malformed JSON and top-level values that are not
objects give no rows. Entries that are not objects keep their position and give
no row. An object without fields gives a row without values. Of a repeated key the last one counts. Repeated rows of the input
give repeated rows; `found` makes rows distinct. Extra columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions import jsontext
from ledgerloom.tables import records, spread

TOP_LISTS = ("line_items", "items")
NESTED_LISTS = ("sub_items",)
#: The fields that become columns of the flat table.
FIELDS = ("date", "type", "description", "quantity", "unit_price", "weight", "payment", "amount", "balance", "total")


class Pairs(list):
    """The members of a JSON object in the order they are written."""


def decode(text: str | None):
    """The parsed text with objects as Pairs, or None where it is not JSON."""
    if not text:
        return None
    try:
        return json.loads(text, object_pairs_hook=Pairs, parse_float=str, parse_int=str)
    except RecursionError:
        return decode_deep(text)
    except ValueError:
        return None


BLANKS = re.compile(r"[ \t\n\r]*")
SCALAR = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?|true|false|null|NaN|-?Infinity")
CONSTANTS = {"true": True, "false": False, "null": None, "NaN": float("nan"), "Infinity": float("inf"), "-Infinity": float("-inf")}


def decode_deep(text: str):
    """What `decode` gives, read token by token with a stack of the open objects and lists."""
    nodes: list[list] = []
    keys: list[str] = []

    def member(at: int) -> int:
        """Takes a key; where its value begins."""
        if text[at : at + 1] != '"':
            raise ValueError(at)
        key, at = json.decoder.scanstring(text, at + 1, True)
        at = BLANKS.match(text, at).end()
        if text[at : at + 1] != ":":
            raise ValueError(at)
        keys.append(key)
        return BLANKS.match(text, at + 1).end()

    try:
        at = BLANKS.match(text).end()
        while True:
            first = text[at : at + 1]
            if first in ("[", "{"):
                value = Pairs() if first == "{" else []
                at = BLANKS.match(text, at + 1).end()
                if text[at : at + 1] != ("}" if first == "{" else "]"):
                    nodes.append(value)
                    at = member(at) if first == "{" else at
                    continue
                at += 1
            elif first == '"':
                value, at = json.decoder.scanstring(text, at + 1, True)
            elif found := SCALAR.match(text, at):
                value, at = CONSTANTS.get(found[0], found[0]), found.end()
            else:
                return None
            # The value ends here, and with it what closes behind it.
            while True:
                at = BLANKS.match(text, at).end()
                if not nodes:
                    return value if at == len(text) else None
                node = nodes[-1]
                inner = isinstance(node, Pairs)
                node.append((keys.pop(), value) if inner else value)
                last = text[at : at + 1]
                if last == ",":
                    at = BLANKS.match(text, at + 1).end()
                    at = member(at) if inner else at
                    break
                if last != ("}" if inner else "]"):
                    return None
                at, value = at + 1, nodes.pop()
    except ValueError:
        return None


def unwrap(value):
    """A value encoded as JSON text, once or more, as the list or object it stands for; other texts stay."""
    while isinstance(value, str) and value.lstrip()[:1] in ("[", "{", '"'):
        inner = decode(value)
        if inner is None:
            return value
        value = inner
    return value


def entries(value) -> list:
    """The entries of a list, however it is written."""
    value = unwrap(value)
    if isinstance(value, Pairs):
        if value and all(k.isdecimal() for k, _ in value):
            return [v for _, v in value]
        return [value]
    return value if isinstance(value, list) else []


def members(node: Pairs) -> dict:
    return dict(node)


def encode_deep(value) -> str:
    """The JSON of a value of any depth, as `json` spaces it."""
    out: list[str] = []
    stack: list[tuple[bool, object]] = [(False, value)]
    while stack:
        ready, x = stack.pop()
        if ready:
            out.append(x)
        elif isinstance(x, Pairs):
            parts = [p for n, (k, v) in enumerate(members(x).items()) for p in ((True, ", " * (n > 0) + json.dumps(k, ensure_ascii=False) + ": "), (False, v))]
            stack += [(True, "}"), *reversed(parts), (True, "{")]
        elif isinstance(x, list):
            parts = [p for n, v in enumerate(x) for p in ((True, ", " * (n > 0)), (False, v))]
            stack += [(True, "]"), *reversed(parts), (True, "[")]
        else:
            out.append(json.dumps(x, ensure_ascii=False))
    return "".join(out)


def plain(value):
    if isinstance(value, Pairs):
        return {k: plain(v) for k, v in value}
    return [plain(v) for v in value] if isinstance(value, list) else value


Triple = tuple[str, str | None, str, int, str | None, str | None]


def repeats(text: str) -> bool:
    """Whether an object in a JSON text has a key twice; raises ValueError where the text is not JSON."""
    found = []

    def seen(pairs):
        if len(pairs) > 1 and len({k for k, _ in pairs}) < len(pairs):
            found.append(True)

    try:
        json.loads(text, object_pairs_hook=seen)
    except RecursionError:
        keys: list[set] = []
        for kind, content in jsontext.events(text):
            if kind == jsontext.OPEN:
                keys.append(set())
            elif kind == jsontext.CLOSE:
                keys.pop()
            elif kind == jsontext.KEY_EVENT:
                found += [True] * (content in keys[-1])
                keys[-1].add(content)
    return bool(found)


def opened(text: str | None) -> str | None:
    """A text that holds a JSON object or list, freed of strings around it and of repeated keys; None if it holds none."""
    while text is not None:
        first = text.lstrip(" \t\n\r")[:1]
        if first not in ("[", "{", '"'):
            return None
        try:
            if not repeats(text):
                if first != '"':
                    return text
                text = json.loads(text)
                continue
            events = jsontext.events(text)
            return value_text(events, *next(events))
        except ValueError:
            return None
    return None


def value_text(events: Iterator[tuple[str, str]], kind: str, content: str) -> str:
    """The JSON of the value that begins with the event given, spaced as JSON writers do; of a repeated key the last value stays."""
    stack: list[tuple[str, dict | list]] = []
    keys: list[str | None] = []
    while True:
        if kind == jsontext.OPEN:
            stack.append((content, {} if content == "{" else []))
            keys.append(None)
        elif kind == jsontext.KEY_EVENT:
            keys[-1] = content
        else:
            if kind == jsontext.CLOSE:
                _, node = stack.pop()
                keys.pop()
                done = "{" + ", ".join(f"{json.dumps(k, ensure_ascii=False)}: {v}" for k, v in node.items()) + "}" if content == "{" else "[" + ", ".join(node) + "]"
            else:
                done = json.dumps(content, ensure_ascii=False) if kind == jsontext.TEXT else content
            if not stack:
                return done
            mark, node = stack[-1]
            if mark == "{":
                node[keys[-1]] = done
            else:
                node.append(done)
        kind, content = next(events)


def skip(events: Iterator[tuple[str, str]], kind: str) -> None:
    """Goes past the value whose first event has been read."""
    depth = int(kind == jsontext.OPEN)
    while depth:
        kind, _ = next(events)
        depth += (kind == jsontext.OPEN) - (kind == jsontext.CLOSE)


def held(events: Iterator[tuple[str, str]]) -> list[tuple[str, str]]:
    """The events up to the end of the object or list that has been opened."""
    out, depth = [], 1
    while depth:
        out.append(next(events))
        depth += (out[-1][0] == jsontext.OPEN) - (out[-1][0] == jsontext.CLOSE)
    return out


class Frame:
    """An entry or a list that is being read: its stream, where it stands, and for a list how far it is."""

    __slots__ = ("events", "path", "name", "ordinal", "counted", "next_key")

    def __init__(self, events, path: str | None, name: str | None = None, counted: bool = False, next_key: str | None = None):
        self.events, self.path, self.name, self.ordinal, self.counted, self.next_key = events, path, name, 0, counted, next_key


def triples(text: str | None, top_lists: tuple[str, ...] | None = TOP_LISTS, nested_lists: tuple[str, ...] | None = NESTED_LISTS, root: bool = False) -> Iterator[Triple]:
    """The triples of one record in the order of its text: (child path, parent path, list name, ordinal, key, value).

    Each listed object first gives a triple without a key, so that an object without fields is kept too. With `root`
    the record itself is an entry as well, with an empty path and list name.
    """
    source = opened(text)
    if source is None or source.lstrip(" \t\n\r")[0] != "{":
        return
    events = jsontext.events(source)
    next(events)
    if root:
        yield "", None, "", 1, None, None
    # The frame's place by path; the record's own fields count only with `root`.
    stack, places = [Frame(events, None)], [("", None, "", 1)]
    while stack:
        frame = stack[-1]
        events = frame.events
        if frame.name is None:
            # An entry: a member is one of its fields or a list below it.
            if frame.next_key is None:
                kind, key = next(events)
                if kind == jsontext.CLOSE:
                    stack.pop()
                    places.pop()
                    continue
            else:
                key, frame.next_key = frame.next_key, None
            kind, content = next(events)
            names = top_lists if frame.path is None else nested_lists
            if names is None or key in names:
                inner = opened(content) if kind == jsontext.TEXT else None
                stream, mark = (events, content) if inner is None else (jsontext.events(inner), None)
                if inner is not None:
                    _, mark = next(stream)
                if kind == jsontext.OPEN or inner is not None:
                    if mark == "[" and names is None:
                        # Without names the first entry tells whether it is a list.
                        ahead = held(stream)
                        if ahead[0] == (jsontext.OPEN, "{"):
                            stack.append(Frame(iter(ahead), frame.path, key))
                            continue
                        value = content if inner is not None else value_text(iter(ahead), jsontext.OPEN, "[")
                    elif mark == "[":
                        stack.append(Frame(stream, frame.path, key))
                        continue
                    elif names is not None:
                        kind, first = next(stream)
                        ahead = None
                        if kind == jsontext.KEY_EVENT and first.isdecimal():
                            ahead = [(kind, first), *held(stream)]
                            depth, counted = 0, True
                            for k, c in ahead:
                                counted &= not (depth == 0 and k == jsontext.KEY_EVENT and not c.isdecimal())
                                depth += (k == jsontext.OPEN) - (k == jsontext.CLOSE)
                            if counted:
                                stack.append(Frame(iter(ahead), frame.path, key, counted=True))
                                continue
                            stream = iter(ahead[1:])
                        path = f"{key}/1" if frame.path is None else f"{frame.path}/{key}/1"
                        yield path, frame.path, key, 1, None, None
                        if kind == jsontext.KEY_EVENT:
                            stack.append(Frame(stream, path, next_key=first))
                            places.append((path, frame.path, key, 1))
                        continue
                    else:
                        value = content if inner is not None else value_text(stream, jsontext.OPEN, mark)
                elif names is not None:
                    continue
                else:
                    value = content if kind == jsontext.TEXT else None if content == "null" else content
            elif frame.path is None and not root:
                skip(events, kind)
                continue
            else:
                value = value_text(events, kind, content) if kind == jsontext.OPEN else content if kind == jsontext.TEXT else None if content == "null" else content
            if frame.path is not None or root:
                yield (*places[-1], key, value)
            continue
        # A list: each object in it, also one written as text, is an entry.
        kind, content = next(events)
        if kind == jsontext.CLOSE:
            stack.pop()
            continue
        if frame.counted:
            kind, content = next(events)
        frame.ordinal += 1
        inner = opened(content) if kind == jsontext.TEXT else None
        stream, mark = events, content if kind == jsontext.OPEN else None
        if inner is not None:
            stream = jsontext.events(inner)
            _, mark = next(stream)
        if mark != "{":
            if inner is None:
                skip(events, kind)
            continue
        path = f"{frame.name}/{frame.ordinal}" if frame.path is None else f"{frame.path}/{frame.name}/{frame.ordinal}"
        yield path, frame.path, frame.name, frame.ordinal, None, None
        stack.append(Frame(stream, path))
        places.append((path, frame.path, frame.name, frame.ordinal))


def flat_schema(keys: list[T.StructField], fields: tuple[str, ...]) -> T.StructType:
    own = ["child_path", "parent_path", "list_name"]
    return T.StructType(
        keys
        + [T.StructField(c, T.StringType()) for c in own]
        + [T.StructField("ordinal", T.LongType()), T.StructField("depth", T.LongType())]
        + [T.StructField(c, T.StringType()) for c in fields]
    )


def flatten(frame: DataFrame, keys: list[str], column: str, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """One row for each listed object of the JSON texts in `column`, with its fields pivoted into columns.

    A record's triples all arise in one task, so grouping and pivoting need no shuffle.
    """
    schema = flat_schema([frame.schema[k] for k in keys], fields)
    frame = frame.select(*keys, column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {f: 5 + i for i, f in enumerate(fields)}
        types = None
        for batch in batches:
            if types is None:
                types = [batch.schema.field(i).type for i in range(len(keys))]
            texts = batch.column(len(keys)).to_pylist()
            source: list[int] = []
            out: list[list] = [[] for _ in range(5 + len(fields))]
            for i, text in enumerate(texts):
                row: dict[str, int] = {}
                for path, parent, name, ordinal, key, value in triples(text):
                    if key is None:
                        row[path] = len(source)
                        source.append(i)
                        for column_values, v in zip(out, (path, parent, name, ordinal, path.count("/") // 2 + 1), strict=False):
                            column_values.append(v)
                        for column_values in out[5:]:
                            column_values.append(None)
                    elif key in place:
                        out[place[key]][row[path]] = value
            at = pa.array(source, pa.int64())
            arrays = [batch.column(i).take(at) for i in range(len(keys))]
            arrays += [pa.array(v, pa.int64() if i in (3, 4) else pa.string()) for i, v in enumerate(out)]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return spread(frame).mapInArrow(run, schema)


def triple_table(frame: DataFrame, keys: list[str], column: str, top_lists: tuple[str, ...] | None = TOP_LISTS, nested_lists: tuple[str, ...] | None = NESTED_LISTS, root: bool = False) -> DataFrame:
    """The path-value-ordinal triples themselves, with `group`, the path without its positions; an entry's first triple has no key."""
    schema = T.StructType(
        [frame.schema[k] for k in keys]
        + [T.StructField(c, T.StringType()) for c in ("child_path", "parent_path", "list_name")]
        + [T.StructField("ordinal", T.LongType())]
        + [T.StructField(c, T.StringType()) for c in ("key", "value")]
    )
    frame = frame.select(*keys, column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, *t) for i, text in enumerate(batch.column(len(keys)).to_pylist()) for t in triples(text, top_lists, nested_lists, root)]
            at = pa.array([x[0] for x in found], pa.int64())
            arrays = [batch.column(i).take(at) for i in range(len(keys))]
            arrays += [pa.array([x[1 + i] for x in found], pa.int64() if i == 3 else pa.string()) for i in range(6)]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return spread(frame).mapInArrow(run, schema).withColumn("group", F.regexp_replace("child_path", r"/\d+(?=/|$)", ""))


def pivot_group(rows: DataFrame, keys: list[str], group: str, fields: list[str]) -> DataFrame:
    """One group of triples as a table: a row per entry of the lists under the path `group` (without positions)."""
    return (
        rows.filter(F.col("group") == group)
        .groupBy(*keys, "child_path", "parent_path", "ordinal")
        .agg(*[F.max(F.when(F.col("key") == f, F.col("value"))).alias(f) for f in fields])
    )


def group_fields(rows: DataFrame, limit: int = 10_000) -> dict[str, list[str]]:
    """The groups of triples with the fields that occur in each. Only these names come to the driver; more than `limit` are an error."""
    found = rows.select("group", "key").distinct().limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"more than {limit} fields of lists; name the lists")
    out: dict[str, list[str]] = {}
    for r in sorted(found, key=lambda r: (r.group, r.key or "")):
        out.setdefault(r.group, []).extend([r.key] if r.key is not None else [])
    return out


def tables(frame: DataFrame, keys: list[str], column: str, top_lists: tuple[str, ...] | None = None, nested_lists: tuple[str, ...] | None = None) -> dict[str, DataFrame]:
    """One table per repeated ancestor, by its path, and under the empty path the table of records. Field names equal to a key get a blank's underscore behind them."""
    rows = triple_table(frame, keys, column, top_lists, nested_lists, root=True)
    own = {*keys, "child_path", "parent_path", "ordinal"}
    out = {}
    for group, fields in group_fields(rows).items():
        table = rows.filter(F.col("group") == group).groupBy(*keys, "child_path", "parent_path", "ordinal")
        made = [F.max(F.when(F.col("key") == f, F.col("value"))).alias(f"{f}_" if f in own else f) for f in fields]
        out[group] = table.agg(*made) if made else table.agg(F.count(F.lit(1)).alias("_")).drop("_")
    return out


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every listed object of the three record tables: src, record_id, child_path."""
    rows = flatten(records(spark, folder, "output"), ["src", "record_id"], "output", ())
    return rows.select("src", "record_id", "child_path").distinct()


def p3_items(spark: SparkSession, folder: str) -> DataFrame:
    """The flat table of listed objects with parent links and their fields."""
    return flatten(records(spark, folder, "output"), ["src", "record_id"], "output").distinct()


def group_query(spark: SparkSession, folder: str, group: str, fields: list[str]) -> DataFrame:
    rows = triple_table(records(spark, folder, "output"), ["src", "record_id"], "output", root=True)
    return pivot_group(rows.distinct(), ["src", "record_id"], group, fields)


def p3_records(spark: SparkSession, folder: str) -> DataFrame:
    """The table of records: what stands outside of all lists."""
    return group_query(spark, folder, "", ["invoice_number", "po_number", "delivery_note_number", "vendor_name", "supplier_name", "currency", "balance_due", "total_amount", "total_weight"]).drop("child_path", "parent_path", "ordinal")


def p3_line_items(spark: SparkSession, folder: str) -> DataFrame:
    """The table of line_items' entries."""
    return group_query(spark, folder, "line_items", list(FIELDS))


def p3_delivery_items(spark: SparkSession, folder: str) -> DataFrame:
    """The table of items' entries."""
    return group_query(spark, folder, "items", ["description", "quantity", "weight"])


def p3_sub_items(spark: SparkSession, folder: str) -> DataFrame:
    """The table of the entries of line_items' sub_items, with the paths of their parents."""
    return group_query(spark, folder, "line_items/sub_items", list(FIELDS))
