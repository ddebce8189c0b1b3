import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.functions import jsontext, match, normalize


def column(spark, values, make):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.o for r in frame.select("i", make(F.col("v")).alias("o")).orderBy("i").collect()]


def test_normalize_name(spark):
    pairs = [("TotalAmount", "totalamount"), ("total amount", "total_amount"), ("invoice-number", "invoice_number"), ("bill to - name", "bill_to_name"), ("  a   b ", "a_b"), ("x y", "x_y"), ("", ""), (None, None)]
    assert column(spark, [a for a, _ in pairs], normalize.normalize_name) == [b for _, b in pairs]


def test_numbers(spark):
    pairs = [("$1,234.50", 1234.5), ("(5)", -5.0), ("$ (5)", None), ("$(5)", -5.0), ("(5 )", -5.0), ("( 5)", None), ("12 $", 12.0), ("１２", 12.0), ("٣٤", 34.0), ("1_0_0", 100.0), ("1_000", 1000.0), ("๑๒", 12.0), ("1e3", 1000.0), ("1.5d", None), ("1.5f", None), ("", None), ("007", 7.0), (None, None), ("a" * 10_000, None)]
    assert column(spark, [a for a, _ in pairs], normalize.parse_number) == [b for _, b in pairs]


def test_dates(spark):
    pairs = [("5/4/2018", "2018-04-05"), ("5/13/2024", "2024-05-13"), ("005/4/2018", None), ("5/4/70", "1970-04-05"), ("5/4/68", "2068-04-05"), ("January  5, 2024", "2024-01-05"), ("Jan 5, 2024", None), ("15/06/2567", "2567-06-15"), ("x", None), (None, None), ("31/02/2024", None)]
    assert column(spark, [a for a, _ in pairs], lambda c: normalize.parse_date(c).cast("string")) == [b for _, b in pairs]
    assert column(spark, ["Jan 5, 2024", "5-4-70"], lambda c: normalize.parse_date(c, normalize.VALIDATE_FORMATS).cast("string")) == ["2024-01-05", "1970-04-05"]


def test_texts(spark):
    assert column(spark, ["a/b.c.pdf", "x", ".hidden"], normalize.file_stem) == ["b.c", "x", ".hidden"]
    assert column(spark, ["x" * 501, "y"], normalize.truncate) == ["x" * 500 + "… [truncated, 501 chars total]", "y"]


PAIRS = [
    (1, 1, True), (None, None, True), ("", None, False), (7570.0, "7,570.00", True), (True, 1, True), (True, "1", True),
    ("  Bangkok   Print & Packaging  ", "bangkok print & packaging", True), ("10/9/2023", "2023-09-10", True), ("10/9/2023", "not-a-date", False),
    ("007", "7", True), ("1e3", "1000", True), ("20230910", "10/9/2023", False),
    ([{"amount": 10, "qty": 2}], '[{"amount": 10.0, "qty": 2}]', True), ({"a": 1, "b": "x"}, '{"a": 1.0, "b": "X "}', True),
    ([1, 2], [2, 1], False), ([], {}, False), ({"a": [{"b": "1,000"}]}, {"a": [{"b": 1000}]}, True), ([1], "1", False),
]


def test_values_match(spark):
    frame = spark.createDataFrame([(i, None if a is None else json.dumps(a), None if b is None else json.dumps(b)) for i, (a, b, _) in enumerate(PAIRS)], "i int, a string, b string")
    got = [r.m for r in frame.select("i", match.values_match(F.col("a"), F.col("b")).alias("m")).orderBy("i").collect()]
    assert got == [m for _, _, m in PAIRS]


json_values = st.recursive(st.none() | st.booleans() | st.integers(-999, 999) | st.sampled_from(["1,000", "(5)", "5/4/2018", "2018-04-05", " A  b", "a B", "[1, 2]", '{"a": 1}', "[1", "~", "a.b", "#"]), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.sampled_from(["a", "b", "a.b", "#0", "~"]), x, max_size=3), max_leaves=6)


def brute(a, b):
    """The rules by recursion over parsed values, with texts of containers read; for the values above only."""
    numbers = {"1,000": 1000, "(5)": -5}
    days = {"5/4/2018": 1, "2018-04-05": 1}

    def opened(v):
        try:
            return json.loads(v) if isinstance(v, str) and v[:1] in "[{" else v
        except ValueError:
            return v

    a, b = opened(a), opened(b)
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(brute, a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(brute(a[k], b[k]) for k in a)
    if isinstance(a, (list, dict)) or isinstance(b, (list, dict)) or a is None or b is None:
        return a is None and b is None
    x, y = (int(v) if isinstance(v, str) and v.lstrip("-").isdecimal() else numbers.get(v, v) for v in (a, b))
    if not isinstance(x, str) and not isinstance(y, str):
        return x == y
    if a in days and b in days:
        return True
    return isinstance(a, str) and isinstance(b, str) and " ".join(a.lower().split()) == " ".join(b.lower().split())


def test_containers_against_recursion(spark):
    pairs = []

    @settings(max_examples=300, deadline=None, database=None)
    @given(json_values, json_values)
    def collect(a, b):
        pairs.extend([(a, b), (a, a), ([a, b], [a, json.dumps(b)])])

    collect()
    frame = spark.createDataFrame([(i, json.dumps(a), json.dumps(b)) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    got = {r.i: r.m for r in frame.select("i", match.values_match(F.col("a"), F.col("b")).alias("m")).collect()}
    assert [p for i, p in enumerate(pairs) if got[i] != brute(*p)] == []


def test_containers_of_any_depth_and_odd_texts(spark):
    deep = "[" * 20_000 + "1" + "]" * 20_000
    rows = [(deep, deep.replace("1", '"1.0"')), (deep, deep.replace("1", "2")), ("[1, 2", "[1, 2"), ("{", "[]"), ('{"a": 1, "a": 2}', '{"a": "2"}')]
    frame = spark.createDataFrame(rows, "a string, b string")
    assert [r.m for r in frame.select(match.values_match(F.col("a"), F.col("b")).alias("m")).collect()] == [True, False, True, False, True]


@pytest.mark.parametrize("text", ['{"a": [1, 2.50, -3e5, {"b": null}], "ก": "\\u0e01\\n", "e": {}, "f": []}', "[]", " 7 ", '"x"', "", "[1,]", '{"a":1,}', '{"a" 1}', '{"a":1} x', "[1 2]", "{1:2}", "[", "tru", "01", '"\t"', "]", "[}", "-", "1."])
def test_events_accept_what_json_accepts(text):
    try:
        json.loads(text)
        good = True
    except ValueError:
        good = False
    try:
        kinds = [k for k, _ in jsontext.events(text)]
    except ValueError:
        kinds = None
    assert (kinds is not None) == good
