"""Quantities recorded in different units, brought to common units (problem 2).

A quantity stands in several columns of a record: its JSON value, the currency
column and the printed line of the page. Each column has a number and the set of
units it may be in. The physical identities tie the columns together - the
printed amount is the recorded amount, so the logarithms of both numbers times
their units are equal - and the combination of units with the smallest log
residual is chosen. Where several units of the value reach that residual, the
solution is not unique and the row says so.

Defined results: a value without digits, or null or malformed JSON, gives no
row. A value whose unit is told nowhere in its record gives a row with
unique_solution = false and no amount. Number marks follow the rule of the
test data: a point, comma or blank before exactly three last digits groups
thousands, before one or two it is the decimal mark; JSON numbers are taken as
they are. Repeated rows give repeated rows; `found` makes rows distinct.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.operators.identities import best_units
from ledgerloom.operators.nested import Pairs, decode, entries, unwrap
from ledgerloom.tables import records, spread, table

# The spellings of each unit of weight and its grams.
WEIGHTS = {
    Fraction(1000): "kg kgs kilo kilos kilogram kilograms กก กิโลกรัม",
    Fraction(1): "g gm gms gr gram grams กรัม",
    Fraction(1_000_000): "t mt ton tons tonne tonnes ตัน",
    Fraction(45359237, 100_000): "lb lbs pound pounds ปอนด์",
    Fraction(28349523125, 10**9): "oz ounce ounces ออนซ์",
}
GRAMS = {word: grams for grams, words in WEIGHTS.items() for word in words.split()}
# The spellings of each currency.
CURRENCIES = {
    "THB": ["thb", "thai baht", "baht", "฿", "บาท"],
    "PHP": ["php", "philippine pesos", "philippine peso", "pesos", "peso", "₱"],
    "USD": ["usd", "us$", "us dollars", "us dollar", "u.s. dollars", "u.s. dollar"],
    "SGD": ["sgd", "s$", "singapore dollars", "singapore dollar"],
    "EUR": ["eur", "euros", "euro", "€"],
    "GBP": ["gbp", "pounds sterling", "pound sterling", "pounds", "£"],
    "MYR": ["myr", "rm", "ringgit"],
    "VND": ["vnd", "dong", "₫"],
}
# Hundredths of a currency.
MINOR = {"satang": "THB", "สตางค์": "THB", "centavos": "PHP", "centavo": "PHP", "euro cents": "EUR", "us cents": "USD", "singapore cents": "SGD", "pence": "GBP", "sen": "MYR"}
DOLLARS = ("USD", "SGD")

THAI = str.maketrans("๐๑๒๓๔๕๖๗๘๙   ", "0123456789   ")
NUMBER = re.compile(r"\d+(?:[.,' ]\d+)*")
LETTER = r"[^\W\d_]|[ะ-๎]"


def words_pattern(words) -> re.Pattern:
    longest = sorted(words, key=len, reverse=True)
    return re.compile("|".join(rf"(?<![^\W\d_]){re.escape(w)}(?!{LETTER})" if w[-1].isalpha() or w[-1] > "฀" else re.escape(w) for w in longest))


WEIGHT_UNIT = words_pattern([*GRAMS, "metric tons", "metric ton"])
CODE = {word: code for code, words in CURRENCIES.items() for word in words}
CURRENCY_UNIT = words_pattern([*CODE, *MINOR, *(f"k{c.lower()}" for c in CURRENCIES)])
GROSS = re.compile(r"\b[gn]\s?\.\s?w\.?\s*[:]?|\((?:gross|net)\)|\bapprox\.?|\bca\.", re.I)
THOUSANDS = re.compile(r"thousand|['’]\s?000|[x×]\s?1[,. ]?000|พัน", re.I)
MILLIONS = re.compile(r"million|['’]\s?000[,. ]?000|[x×]\s?1[,. ]?000[,. ]?000|ล้าน", re.I)
WEIGHT_SAID = re.compile(r"(?:unit of weight[^:\n]*:|weights?(?: are| is)?(?: given| stated| shown| quoted| expressed| listed)? in|\(?wt\.? unit:|\bwt\.? ?\(|weight ?\(|หน่วยน้ำหนัก[^:\n]*:?)\s*([^\n)]+)", re.I)
MONEY_SAID = re.compile(r"(?:(?:amounts?|prices?|figures|sums|values|totals?)(?: are| is)?(?: given| stated| shown| quoted| expressed| listed)? in|currency ?:|สกุลเงิน ?:?)\s*([^\n]+)", re.I)
SCALE_SAID = re.compile(r"(?:amounts?|figures|values|prices)[^\n]*", re.I)
PRINTED = re.compile(r"^(?:balance due|amount due|grand total|total(?: amount| due)?) ?: *([^\n]*)", re.I | re.M)
DOLLAR_SAID = re.compile(r"(us|u\.s\.|singapore) dollars?|\b(us|s)\$|\b(usd|sgd)\b", re.I)


def number(text: str) -> Fraction | None:
    """The number that a text of digits and marks stands for."""
    parts = re.split(r"([.,' ])", text)
    digits, marks = parts[::2], parts[1::2]
    if not marks:
        return Fraction(digits[0])
    if len(digits[-1]) == 3:
        return Fraction("".join(digits))
    if marks[-1] in ".,":
        return Fraction("".join(digits[:-1]) + "." + digits[-1])
    return None


@lru_cache(maxsize=65536)
def weight(value: str) -> tuple[Fraction | None, Fraction | None]:
    """Number and grams of its unit of a weight text; a compound like 3 lb 2 oz is given in grams."""
    text = GROSS.sub(" ", value.translate(THAI).lower()).replace("metric ton", "ton")
    units = [(m.start(), m.end(), GRAMS[m[0]]) for m in WEIGHT_UNIT.finditer(text)]
    numbers = [(m.start(), m.end(), number(m[0])) for m in NUMBER.finditer(text)]
    if len(numbers) > 1 and len(units) == len(numbers) and None not in (n for _, _, n in numbers) and all(n[1] <= u[0] for n, u in zip(numbers, units, strict=True)):
        return sum(n[2] * u[2] for n, u in zip(numbers, units, strict=True)), Fraction(1)
    if len(numbers) != 1 or numbers[0][2] is None:
        return None, None
    return numbers[0][2], units[0][2] if units else None


@lru_cache(maxsize=65536)
def money(value: str) -> tuple[Fraction | None, str | None, Fraction | None]:
    """Number, currency and scale of an amount text; "$" for a bare dollar sign, no scale where none is told."""
    text = value.translate(THAI).lower()
    scale = Fraction(10**6) if MILLIONS.search(text) else Fraction(1000) if THOUSANDS.search(text) else None
    text = MILLIONS.sub(" ", text)
    text = THOUSANDS.sub(" ", text)
    code = None
    if unit := CURRENCY_UNIT.search(text):
        word = unit[0]
        if word in MINOR:
            code, scale = MINOR[word], Fraction(1, 100)
        elif word in CODE:
            code = CODE[word]
        else:
            code, scale = word[1:].upper(), Fraction(1000)
        text = text.replace(word, " ")
    elif "$" in text:
        code = "$"
    found = NUMBER.findall(text)
    return number(found[0]) if len(found) == 1 else None, code, scale


#: The largest log residual of an identity that counts as met.
TOLERANCE = 1e-3
#: The identity of a recorded and a printed amount.
EQUAL = np.array([[1.0, -1.0]])


def residuals(value: Fraction, units: dict, other: Fraction, known: dict) -> dict:
    """Per unit of `value` the least log residual of its identity with another column, whatever unit that one is in."""
    if value <= 0 or other <= 0:
        return {n: 0.0 if any(value * unit == other * u for u in known.values()) else math.inf for n, unit in units.items()}
    pair = np.array([[float(value), float(other)]])
    sizes = np.array([float(u) for u in known.values()])
    return {n: round(float(best_units(pair, [np.array([float(unit)]), sizes], EQUAL)[2][0]), 9) for n, unit in units.items()}


def solve(value: Fraction, units: dict, others: list[tuple[Fraction, dict]]):
    """The unit of `value` that the identity with one of the others leaves the smallest log residual for.

    `units` and the second members of `others` map the units that each column may be in to their sizes.
    Returns the unit and whether no other unit does as well.
    """
    told = [residuals(value, units, other, known) for other, known in others]
    scores = {name: min((t[name] for t in told), default=0.0) for name in units}
    least = min(scores.values())
    best = {units[n]: n for n, s in scores.items() if s == least}
    return next(iter(best.values())), len(best) == 1 and least <= TOLERANCE


def text_of(value) -> tuple[str | None, bool]:
    """A JSON value as text, and whether it was written as a JSON number."""
    if isinstance(value, Plain):
        return str(value), True
    return (value, False) if isinstance(value, str) and value.strip() else (None, False)


class Plain(str):
    """A JSON number as it is written."""


def decode_plain(text: str | None):
    import json

    if not text:
        return None
    try:
        return json.loads(text, object_pairs_hook=Pairs, parse_float=Plain, parse_int=Plain)
    except (ValueError, RecursionError):
        return None


def read_weight(value) -> tuple[Fraction | None, Fraction | None]:
    text, plain = text_of(value)
    if text is None:
        return None, None
    return (Fraction(Decimal(text)), None) if plain else weight(text)


ALL_GRAMS = {str(g): g for g in WEIGHTS}


def weights_of(page: str | None, output: str | None) -> Iterator[tuple[str, int, Fraction | None, str | None, bool]]:
    """(field, position, grams, unit, unique) of each weight of a delivery note."""
    top = unwrap(decode_plain(output))
    if not isinstance(top, Pairs):
        return
    page = page or ""
    fields = dict(top)
    said = None
    for m in WEIGHT_SAID.finditer(page):
        if unit := WEIGHT_UNIT.search(GROSS.sub(" ", m[1].lower()).replace("metric ton", "ton")):
            said = GRAMS[unit[0]]
            break
    wanted = [("total_weight", 0, fields.get("total_weight"), re.compile(r"^[^\n]*(?:gross|total|net) weight ?: *([^\n]*)", re.I | re.M))]
    for position, entry in enumerate(entries(fields.get("items")), 1):
        entry = unwrap(entry)
        if isinstance(entry, Pairs):
            item = dict(entry)
            name = item.get("description")
            printed = re.compile(rf"^\s*\d+\.\s*{re.escape(name)}\b.* - ([^\n]*)$", re.M) if isinstance(name, str) and name.strip() else None
            wanted.append(("items.weight", position, item.get("weight"), printed))
    for field, position, value, printed in wanted:
        amount, unit = read_weight(value)
        if amount is None:
            continue
        unit = unit or said
        others = []
        if unit is None and printed:
            for m in printed.finditer(page):
                other, other_unit = weight(m[1])
                if other is not None and other_unit is not None:
                    others.append((other, {"printed": other_unit}))
        name, unique = solve(amount, {str(unit): unit} if unit else ALL_GRAMS, others)
        size = unit or ALL_GRAMS[name]
        yield field, position, amount * size if unique else None, "g" if unique else None, unique


def amounts_of(page: str | None, output: str | None, field: str, rates: dict[str, int]) -> Iterator[tuple[str, int, Fraction | None, str | None, bool]]:
    """(field, 0, US cents, currency, unique) of a record's amount; `rates` in millionths of a dollar."""
    top = unwrap(decode_plain(output))
    if not isinstance(top, Pairs):
        return
    page = page or ""
    fields = dict(top)
    text, plain = text_of(fields.get(field))
    if text is None:
        return
    amount, code, scale = (Fraction(Decimal(text)), None, None) if plain else money(text)
    if amount is None:
        return
    own, _ = text_of(fields.get("currency"))
    if own:
        _, told, told_scale = money(own)
        code = code or told
        scale = scale or told_scale
    said, said_scale = None, None
    for m in MONEY_SAID.finditer(page):
        _, said_here, scale_here = money(m[1])
        said = said or (said_here if said_here != "$" else None)
    for m in SCALE_SAID.finditer(page):
        if MILLIONS.search(m[0]):
            said_scale = Fraction(10**6)
        elif THOUSANDS.search(m[0]):
            said_scale = Fraction(1000)
    scale = scale or said_scale
    if code == "$":
        dollar = next(((m[1] or m[2] or m[3]).lower() for m in DOLLAR_SAID.finditer(page)), None)
        code = None if dollar is None else "SGD" if dollar[0] == "s" else "USD"
        if code is None:
            code = said if said in DOLLARS else None
            if code is None:
                yield field, 0, None, None, False
                return
    code = code or said
    others = []
    if code is None:
        for m in PRINTED.finditer(page):
            other, other_code, other_scale = money(m[1])
            if other is not None and other_code in rates:
                others.append((other, {other_code: (other_scale or scale or 1) * rates[other_code]}))
    if code is not None and code not in rates:
        return
    name, unique = solve(amount, {c: (scale or 1) * rates[c] for c in ([code] if code else rates)}, others)
    yield field, 0, amount * (scale or 1) * rates[name] / 10_000 if unique else None, name if unique else None, unique


def whole(value: Fraction | None) -> int | None:
    if value is None:
        return None
    result = math.floor(value + Fraction(1, 2))
    return result if abs(result) < 2**63 else None


AMOUNT_FIELDS = {"invoices": "balance_due", "purchase_orders": "total_amount"}

SCHEMA = T.StructType(
    [
        T.StructField("src", T.StringType()),
        T.StructField("record_id", T.LongType()),
        T.StructField("field", T.StringType()),
        T.StructField("pos", T.LongType()),
        T.StructField("amount", T.LongType()),
        T.StructField("unit", T.StringType()),
        T.StructField("unique_solution", T.BooleanType()),
    ]
)


def common_units(frame: DataFrame, rates: dict[str, int]) -> DataFrame:
    """Grams and US cents of every quantity of the records (src, record_id, input_text, output)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.to_pydict()
            rows = []
            for src, key, page, output in zip(columns["src"], columns["record_id"], columns["input_text"], columns["output"], strict=True):
                found = weights_of(page, output) if src == "delivery_notes" else amounts_of(page, output, AMOUNT_FIELDS[src], rates)
                rows += [(src, key, field, pos, whole(size), unit, unique) for field, pos, size, unit, unique in found]
            yield pa.RecordBatch.from_pylist([dict(zip(SCHEMA.names, r, strict=True)) for r in rows], schema=pa.schema([("src", pa.string()), ("record_id", pa.int64()), ("field", pa.string()), ("pos", pa.int64()), ("amount", pa.int64()), ("unit", pa.string()), ("unique_solution", pa.bool_())]))

    return spread(frame.select("src", "record_id", "input_text", "output")).mapInArrow(run, SCHEMA)


def rate_table(spark: SparkSession, folder: str, limit: int = 1000) -> dict[str, int]:
    """The exchange rates as a dict; the table holds one row per currency, so more than `limit` rows is an error."""
    rows = table(spark, folder, "fx_rates").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"fx_rates has more than {limit} rows; it is meant to hold one per currency")
    return {r.currency_code: r.usd_micros for r in rows if r.usd_micros is not None}


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Grams and US cents of each value whose unit can be told: src, record_id, field, pos, amount."""
    rows = common_units(records(spark, folder, "input_text", "output"), rate_table(spark, folder))
    return rows.filter("unique_solution and amount is not null").select("src", "record_id", "field", "pos", "amount").distinct()


def p2_flagged(spark: SparkSession, folder: str) -> DataFrame:
    """The values for which several units fit equally well."""
    rows = common_units(records(spark, folder, "input_text", "output"), rate_table(spark, folder))
    return rows.filter(~F.col("unique_solution")).select("src", "record_id", "field", "pos").distinct()
