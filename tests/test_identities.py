import itertools
import math
import random

import pytest

from ledgerloom.operators import identities

MASS = {"kg": 1.0, "g": 0.001, "lb": 0.45359237}
DENSITY = {"kg/m3": 1.0, "g/cm3": 1000.0}
VOLUME = {"m3": 1.0, "l": 0.001, "cm3": 1e-6}
LAW = [{"mass": 1, "density": -1, "volume": -1}]


def test_mass_is_density_times_volume(spark):
    rng = random.Random(1)
    rows = []
    for n in range(200):
        density, volume = rng.uniform(600, 9000), rng.uniform(0.01, 3)
        m, d, v = rng.choice(list(MASS)), rng.choice(list(DENSITY)), rng.choice(list(VOLUME))
        rows.append((n, density * volume / MASS[m], density / DENSITY[d], volume / VOLUME[v], m, d, v))
    frame = spark.createDataFrame(rows, "id bigint, mass double, density double, volume double, m string, d string, v string")
    got = identities.solve_units(frame, {"mass": MASS, "density": {"kg/m3": 1.0}, "volume": {"m3": 1.0}}, LAW).filter("d = 'kg/m3' and v = 'm3'").collect()
    assert got and all(r.mass_unit == r.m and r.mass_solved and r.residual < 1e-9 for r in got)
    # Three free columns: kg with l is g with cm3 of a denser thing, so a row may have several solutions, which are flagged.
    for r in identities.solve_units(frame, {"mass": MASS, "density": DENSITY, "volume": VOLUME}, LAW).collect():
        fits = [c for c in itertools.product(MASS, DENSITY, VOLUME) if abs(math.log(r.mass * MASS[c[0]] / (r.density * DENSITY[c[1]] * r.volume * VOLUME[c[2]]))) < 1e-6]
        assert (r.m, r.d, r.v) in fits
        for k, name in enumerate(("mass", "density", "volume")):
            assert r[f"{name}_solved"] == (len({c[k] for c in fits}) == 1)


def test_sums_of_several_identities_and_dirty_rows(spark):
    laws = [{"a": 1, "b": -1}, {"a": 1, "c": -1}]
    units = {"a": {"x": 1.0, "y": 10.0}, "b": {"x": 1.0}, "c": {"x": 1.0}}
    rows = [(1, 5.0, 50.0, 50.0), (1, 5.0, 50.0, 50.0), (2, 5.0, None, 5.0), (3, 5.0, None, None), (4, None, 1.0, 1.0), (5, -5.0, 5.0, 5.0), (6, 7.0, 1.0, 1.0)]
    frame = spark.createDataFrame(rows, "id int, a double, b double, c double")
    got = [(r.id, r.a_common, r.a_solved, r.b_solved) for r in identities.solve_units(frame, units, laws).collect()]
    assert sorted(got, key=lambda g: g[0]) == [(1, 50.0, True, True), (1, 50.0, True, True), (2, 5.0, True, False), (3, None, False, False), (4, None, False, True), (5, None, False, True), (6, None, False, True)]
    assert identities.solve_units(frame.limit(0), units, laws).count() == 0


def test_too_many_combinations(spark):
    with pytest.raises(ValueError):
        identities.solve_units(spark.createDataFrame([], "a double, b double"), {c: {str(k): float(k + 1) for k in range(70)} for c in "ab"}, [])
