import json
from fractions import Fraction

import pytest

from ledgerloom.operators import units

RATES = {"USD": 1_000_000, "THB": 28_617, "SGD": 743_219, "EUR": 1_087_331, "GBP": 1_264_177, "PHP": 17_433}


@pytest.mark.parametrize(
    ("text", "want"),
    [("1,234", 1234), ("1.234", 1234), ("1 234", 1234), ("12,5", Fraction(25, 2)), ("1.234,50", Fraction(2469, 2)), ("1,234,567", 1234567), ("12.34", Fraction(617, 50)), ("7", 7)],
)
def test_number_marks(text, want):
    assert units.number(text) == want


@pytest.mark.parametrize(
    ("value", "grams"),
    [("2 kg", 2000), ("kg. 22.1", 22100), ("131kg.", 131000), ("G.W. 5 kilos", 5000), ("3 lb 2 oz", Fraction(3 * 45359237, 100000) + 2 * Fraction(28349523125, 10**9)), ("1.5 MT", 1_500_000), ("๔.๙ kilos (gross)", 4900), ("4519.3 G ", Fraction(45193, 10)), ("9 kg 9 g", 9009), ("12 กก.", 12000), ("2 ตัน", 2_000_000)],
)
def test_weights(value, grams):
    amount, unit = units.weight(value)
    assert amount * unit == grams


@pytest.mark.parametrize("value", ["n/a", "unknown", "", "2 x 3 kg"])
def test_no_weight(value):
    assert units.weight(value)[0] is None


def amounts(value, currency=None, page="", field="total_amount"):
    record = {field: value} | ({"currency": currency} if currency is not None else {})
    rows = list(units.amounts_of(page, json.dumps(record), field, RATES))
    return rows[0][2:] if rows else None


def cents(*args, **kwargs):
    found = amounts(*args, **kwargs)
    return units.whole(found[0]) if found and found[2] else None


def test_amounts():
    assert cents(10, "USD") == 1000
    assert cents("US$ 1,000") == 100000
    assert cents(250, "US cents") == 250
    assert cents(3, "USD thousands") == 300000
    assert cents(3, "kUSD") == 300000
    assert cents(3, "USD", page="All figures x 1,000") == 300000
    assert cents(3, "kUSD", page="Amounts in thousands") == 300000
    assert cents(100, "satang") == units.whole(Fraction(28617, 10000))
    assert cents(5, "$", page="All prices in Singapore dollars") == units.whole(Fraction(5 * 743219, 10000))
    assert cents(5, None, page="Prices quoted in USD") == 500
    assert cents("฿34,589") == units.whole(Fraction(34589 * 28617, 10000))


def test_printed_amount_settles_the_currency():
    assert cents(414.54, None, page="Balance Due: 414.54\nTotal: USD 414.54") == 41454
    assert amounts(414.54, None, page="Total: USD 999.99")[2] is False


def test_unit_told_nowhere_is_flagged():
    assert amounts(5, "N/A")[2] is False
    assert amounts(5, "$")[2] is False
    note = json.dumps({"total_weight": "5", "items": []})
    assert [r[4] for r in units.weights_of("", note)] == [False]


def test_stated_unit_holds_for_bare_weights_only():
    note = json.dumps({"total_weight": "5", "items": [None, {"description": "a", "weight": 2}, {"description": "b", "weight": "3 lb"}]})
    rows = {(f, p): g for f, p, g, _, _ in units.weights_of("All weights in kg", note)}
    assert rows[("total_weight", 0)] == 5000 and rows[("items.weight", 2)] == 2000 and rows[("items.weight", 3)] == Fraction(3 * 45359237, 100000)


def test_rounding_is_half_up():
    assert [units.whole(Fraction(x, 2)) for x in (1, 3, 5, -1)] == [1, 2, 3, 0]


def test_dirty_rows_extra_columns_and_empty_table(spark):
    rows = [("invoices", 1, None, None, 0), ("invoices", 2, "x", "not json", 0), ("delivery_notes", 3, None, '{"total_weight": "2 kg"}', 0), ("delivery_notes", 3, None, '{"total_weight": "2 kg"}', 0)]
    frame = spark.createDataFrame(rows, "src string, record_id bigint, input_text string, output string, amount int")
    assert [tuple(r)[:5] for r in units.common_units(frame, RATES).collect()] == [("delivery_notes", 3, "total_weight", 0, 2000)] * 2
    assert units.common_units(frame.limit(0), RATES).count() == 0


def test_whole_table_runs(spark, tiny):
    rows = units.p2_found(spark, tiny).collect()
    assert rows and len({(r.src, r.record_id, r.field, r.pos) for r in rows}) == len(rows)
