"""Contradicting towns and countries, large sets of like addresses, and tiles of blocks."""

import itertools
import random

from ledgerloom.llm import addresses, graph


def places(spark, rows):
    frame = spark.createDataFrame([(r,) for r in rows], "text string")
    out = {}
    for r in addresses.same_places(frame).collect():
        out.setdefault(r.place, set()).add(r.text)
    return {frozenset(v) for v in out.values()}


def test_other_towns_are_other_places(spark):
    rows = ["12 Mabini Street, Manila", "12 Mabini St., Cebu City", "12 Mabini Street"]
    assert places(spark, rows) == {frozenset([r]) for r in rows}
    assert places(spark, rows[:1] + rows[2:]) == {frozenset(rows[:1] + rows[2:])}


def test_a_bridge_doesnt_join_contradictions(spark):
    rows = ["12 Mabini Street, 10110, Thailand", "12 Mabini Street", "12 Mabini Street, 99999, United States"]
    assert places(spark, rows) == {frozenset([r]) for r in rows}
    countries = ["12 Mabini Street, Springfield, Malaysia", "12 Mabini Street, Springfield", "12 Mabini Street, Springfield, Germany"]
    assert places(spark, countries) == {frozenset([r]) for r in countries}


def test_a_town_and_its_province_are_one_place(spark):
    told = ["3 Ortega Road, Bayombong, Vizcaya", "9 Luna Avenue, Bayombong, Vizcaya"]
    pair = ["12 Mabini Street, Bayombong", "12 Mabini Street, Vizcaya"]
    assert frozenset(pair) in places(spark, told + pair)
    assert frozenset(pair) not in places(spark, pair)


def test_many_entries_with_equal_strict_parts(spark):
    """A hundred times the window: links found against those of all pairs."""
    rng = random.Random(9)
    syllables = [a + b for a in "bdfgklmnprst" for b in "aeiou"]
    streets = sorted({"".join(rng.choices(syllables, k=rng.choice((3, 4, 5)))) for _ in range(1000)})
    rows = []
    for name in streets:
        k, j = sorted(rng.sample(range(len(name) - 1), 2))
        swapped = name[:k] + name[k + 1] + name[k] + name[k + 2 :]
        dropped = name[:j] + name[j + 1 :]
        rows += [f"7 {n} Road" for n in (name, swapped, dropped)]
    rows = sorted(set(rows))
    parts = {r: addresses.parse(r) for r in rows}
    want = {(a, b) for a, b in itertools.combinations(rows, 2) if abs(len(a) - len(b)) <= 2 and addresses.same_place(parts[a], parts[b])}
    keys = spark.createDataFrame([{"id": r} | {p: parts[r][p] for p in addresses.PARTS[:9]} for r in rows])
    got = {tuple(sorted((r.a, r.b))) for r in addresses.links(keys).collect()}
    assert got <= want and len(want) > 2000
    assert len(got) >= 0.99 * len(want)


def test_tiles_give_every_pair_once(spark):
    rows = [(f"n{i:03d}", "hot") for i in range(150)] + [(f"n{i:03d}", "cold") for i in range(0, 150, 40)] + [("alone", "x")]
    members = spark.createDataFrame([*rows, rows[0]], "id string, block string")
    got = [tuple(r) for r in graph.block_pairs(members, 7).collect()]
    assert sorted(got) == sorted(itertools.combinations([f"n{i:03d}" for i in range(150)], 2))
    assert graph.block_pairs(members.limit(0)).count() == 0
