import itertools
import random

import pytest

from ledgerloom.llm import addresses, names
from ledgerloom.llm.graph import components, pairs_within
from ledgerloom.llm.strings import edits, jaro_winkler


def groups(frame, label):
    out = {}
    for r in frame.collect():
        out.setdefault(r[label], set()).add(r.text)
    return {frozenset(v) for v in out.values()}


def texts(spark, values):
    return spark.createDataFrame([(v,) for v in values], "text string")


NAMES = [
    {"Tibidu Gerulir International GmbH", "Tibidu Gerulir, International (Gmbh)", "Tibidu Geriulir International GmbH", "Tibidu Geru. International GmbH", "Tibidu Grlr Intl", "GERULIR TIBIDU INTERNATIONAL G.M.B.H."},
    {"Tibidu Gesamus International GmbH", "The Tibidu Gesamus International GmbH"},
    {"Titufo-Kavugene Chemicals GmbH", "Titufo-Kvgn Chemic."},
    {"Titufo and Kavodu Chemicals GmbH", "Titufo and Kaodu Chemicals GmbH"},
    {"Anthony Relivuruth", "Tony Relivuruth", 'Anthony "Tony" Relivuruth', "Relivuruth, Anthony", "A. Relivuruth", "Arithony Relivuruth"},
    {"Theodore Kegosidux", "Theo Kegosidux", "Theodore Kegsoidux"},
    {"บริษัท ธารพลบุญภูมิมา จำกัด", "บจก. ธารพลบุญภูมิมา", "บริษัทธารพลบุญภูมิมาจำกัด"},
    {"Engr. Richard Debigafas", "Rick Debigafas"},
]
PLACES = [
    {"Room 38, 644 Neverugix Highway, Fort Harlan Ridge 99410, United States", "Room 38 644 Neverusgix Highway United States", "#38, 644 neverugix hway", "99410 Fort Harlan Ridge, Rm. 38, Neverugix Hwy 644"},
    {"644 Neverugix Highway, Fort Harlan Ridge 99410, United States"},
    {"644A Neverugix Highway, Fort Harlan Ridge 99410, United States", "#644a neverugix hway, fort harlan ridge 99410, united states"},
    {"Unit 38, 644 Neverugix Street, Fort Harlan Ridge 99410, United States"},
    {"16th Floor, 122 Bakamunul Highway, East Cobblerton 98100, United States", "122 Bakmunul Hway 16th Fl. E Cobblerton"},
    {"84 ถนนกามณีทองสินนที แขวงบางสร้อย นครธรรมริน 81011", "๘๔ ถ.กามณีทองสินนที บางสร้อย"},
]


def test_names(spark):
    rows = [n for g in NAMES for n in g]
    got = groups(names.same_names(texts(spark, [*rows, *rows, None])), "entity")
    assert got == {frozenset(g) for g in NAMES}


def test_ambiguous_initial_joins_nobody(spark):
    rows = ["Alexander Bakamunul", "Anthony Bakamunul", "A. Bakamunul"]
    assert len(groups(names.same_names(texts(spark, rows)), "entity")) == 3


def test_places(spark):
    rows = [n for g in PLACES for n in g]
    got = groups(addresses.same_places(texts(spark, [*rows, *rows, None])), "place")
    assert got == {frozenset(g) for g in PLACES}


def test_windows_find_what_all_pairs_find(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(60):
        number, street = rng.randrange(1, 9), "".join(rng.choices("abdegikmnorstu", k=9))
        rows += [f"{number} {street} Road", f"{number} {street[:4]}{street[5:]} Rd", f"{number} {street[::-1]} Road"]
    got = groups(addresses.same_places(texts(spark, rows)), "place")
    parts = {r: addresses.parse(r) for r in rows}
    linked = {r: {r} for r in rows}
    for a, b in itertools.combinations(rows, 2):
        if addresses.same_place(parts[a], parts[b]):
            merged = linked[a] | linked[b]
            for r in merged:
                linked[r] = merged
    assert got == {frozenset(g) for g in linked.values()}


@pytest.mark.parametrize("odd", ["", "   ", "???", "7", "x" * 20_000, "Unit", "#", "'"])
def test_odd_texts(odd):
    addresses.parse(odd)
    names.parse(odd)


def test_empty_tables(spark):
    none = texts(spark, []) if False else spark.createDataFrame([], "text string")
    assert names.same_names(none).count() == 0
    assert addresses.same_places(none).count() == 0


def test_components_of_chains_and_stars(spark):
    chain = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(70)]
    star = [("s", f"t{i}") for i in range(20)]
    rows = components(spark.createDataFrame([*chain, *star, ("x", "x")], "a string, b string")).collect()
    labels = {r.node: r.component for r in rows}
    assert {labels[f"c{i:03d}"] for i in range(71)} == {"c000"} and {labels[f"t{i}"] for i in range(20)} == {"s"}


def test_pairs_are_in_byte_order(spark):
    frame = spark.createDataFrame([("g", "b"), ("g", "B"), ("g", "é"), ("g", "b"), ("h", "q")], "g string, t string")
    assert {tuple(r) for r in pairs_within(frame, "g", "t", "a", "b").collect()} == {("B", "b"), ("B", "é"), ("b", "é")}


def test_distances():
    assert [edits(a, b) for a, b in (("ab", "ba"), ("kitten", "sitting"), ("", "x"))] == [1, 3, 1]
    assert jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    assert jaro_winkler("dwayne", "duane") == pytest.approx(0.84, abs=1e-3)
