import json

import pytest

from ledgerloom.operators import nested


def brute(value, prefix, names):
    """Child paths by plain recursion."""
    found = []
    while isinstance(value, str):
        try:
            value = json.loads(value)
        except ValueError:
            return found
    if not isinstance(value, dict):
        return found
    for name in names:
        entries = value.get(name)
        while isinstance(entries, str):
            try:
                entries = json.loads(entries)
            except ValueError:
                entries = None
        if isinstance(entries, dict):
            entries = list(entries.values()) if entries and all(k.isdecimal() for k in entries) else [entries]
        for n, e in enumerate(entries or [], 1):
            if isinstance(e, dict):
                path = f"{prefix}{name}/{n}"
                found += [path, *brute(e, path + "/", ("sub_items",))]
    return found


CASES = [
    None,
    "",
    "not json",
    "[]",
    "3",
    '{"line_items": null}',
    '{"line_items": []}',
    '{"line_items": [{"description": "a"}, null, "-", {"quantity": 2}]}',
    '{"items": {"description": "alone"}}',
    '{"items": {"10": {"a": 1}, "11": "x", "12": {"b": 2}}}',
    json.dumps({"items": json.dumps([{"sub_items": {"description": "s", "sub_items": json.dumps([{"q": 1}, 3])}}])}),
    '{"line_items": [{}], "items": [{"x": 1}]}',
]


@pytest.mark.parametrize("text", CASES)
def test_triples_against_recursion(text):
    got = [t[0] for t in nested.triples(text) if t[4] is None]
    assert sorted(got) == sorted(brute(text, "", nested.TOP_LISTS) if text else [])


def test_deep_nesting_without_limit():
    record = {"description": "leaf"}
    for _ in range(150):
        record = {"sub_items": [record]}
    paths = [t[0] for t in nested.triples(json.dumps({"items": [record]})) if t[4] is None]
    assert len(paths) == 151


def test_flatten_keeps_links_fields_and_extra_columns(spark):
    rows = [(1, CASES[7], "x"), (1, CASES[7], "x"), (2, None, "y"), (3, CASES[10], "z")]
    frame = spark.createDataFrame(rows, "record_id bigint, output string, child_path string")
    flat = nested.flatten(frame, ["record_id"], "output").collect()
    assert sum(r.record_id == 1 for r in flat) == 4
    deepest = max((r for r in flat if r.record_id == 3), key=lambda r: r.depth)
    assert deepest.parent_path == "items/1/sub_items/1" and deepest.child_path == deepest.parent_path + "/sub_items/1"
    assert {r.description for r in flat if r.record_id == 1} == {"a", None}


def test_pivot_of_triples_equals_flatten(spark):
    frame = spark.createDataFrame([(1, CASES[7]), (2, CASES[9])], "record_id bigint, output string")
    pivot = nested.pivot_group(nested.triple_table(frame, ["record_id"], "output"), ["record_id"], "line_items", ["description", "quantity"])
    flat = nested.flatten(frame, ["record_id"], "output").filter("list_name = 'line_items'").select(*pivot.columns)
    assert {tuple(r) for r in pivot.collect()} == {tuple(r) for r in flat.collect()}


def test_unknown_lists_make_a_table_each(spark):
    texts = ['{"order": "a", "child_path": "x", "orders": [{"sku": "s1", "parts": [{"n": 1}, {"n": 2, "sizes": [3, 4]}]}, {"sku": "s2"}], "tags": ["u", "v"]}', '{"order": "b", "orders": []}', None, "bad"]
    frame = spark.createDataFrame(list(enumerate(texts)), "k bigint, t string")
    made = nested.tables(frame, ["k"], "t")
    assert sorted(made) == ["", "orders", "orders/parts"]
    assert {(r.k, r.order, r.child_path_, r.tags, r.orders) for r in made[""].collect()} == {(0, "a", "x", '["u", "v"]', None), (1, "b", None, None, "[]")}
    assert {(r.k, r.child_path, r.sku) for r in made["orders"].collect()} == {(0, "orders/1", "s1"), (0, "orders/2", "s2")}
    assert {(r.parent_path, r.ordinal, r.n, r.sizes) for r in made["orders/parts"].collect()} == {("orders/1", 1, "1", None), ("orders/1", 2, "2", "[3, 4]")}
    assert nested.tables(frame.limit(0), ["k"], "t") == {}


def test_repeated_keys_and_lists_before_fields():
    text = '{"items": [{"a": 1}], "items": [{"sub_items": {"q": 1}, "a": 2, "a": "3"}, "{\\"a\\": 4}"]}'
    got = [(t[0], t[4], t[5]) for t in nested.triples(text)]
    assert got == [("items/1", None, None), ("items/1/sub_items/1", None, None), ("items/1/sub_items/1", "q", "1"), ("items/1", "a", "3"), ("items/2", None, None), ("items/2", "a", "4")]


def test_empty_table(spark):
    frame = spark.createDataFrame([], "record_id bigint, output string")
    assert nested.flatten(frame, ["record_id"], "output").count() == 0


def test_whole_table(spark, tiny):
    got = {tuple(r) for r in nested.p3_found(spark, tiny).collect()}
    want = set()
    for src in ("invoices", "purchase_orders", "delivery_notes"):
        for r in spark.read.parquet(f"{tiny}/{src}.parquet").collect():
            want |= {(src, r.record_id, p) for p in brute(r.output, "", nested.TOP_LISTS)}
    assert got == want
