"""Names outside the nickname table, and short forms without a full spelling."""

import pytest

from ledgerloom.llm import names

GROUPS = [
    [{"Charlotte Muller", "Charlotte Mueller", "Muller, Charlotte"}, {"Charlotta Brown"}, {"Henrik Muller"}],
    [{"Tibidu Grlr International GmbH", "Tibiduu Grlr Intl GmbH"}, {"Tibidu Kvgn International GmbH"}],
    [{"Tibidu Geru. International GmbH", "Tibidu Gerru. International GmbH"}],
    [{"T. Kegosidux", "T. Kegsoidux", "Ted Kegosidux"}],
    [{"T. Kegosidux", "T. Kegsoidux"}, {"E. Kegosidux", "E. Kegsoidux"}, {"Ted Kegosidux"}],
    [{"Theodore Kegosidux", "T. Kegosidux", "T. Kegsoidux", "Ted Kegosidux"}, {"E. Kegosidux"}],
    [{"Alexander Bakamunul"}, {"Anthony Bakamunul"}, {"A. Bakamunul"}, {"A. Bakmaunul"}],
]


@pytest.mark.parametrize("want", GROUPS)
def test_short_forms(spark, want):
    rows = [(n,) for g in want for n in sorted(g)]
    got = {}
    for r in names.same_names(spark.createDataFrame(rows, "text string")).collect():
        got.setdefault(r.entity, set()).add(r.text)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want))


def test_only_shortened_given_names_are_short():
    assert [names.parse(n)["short"] for n in ("Charlotte Muller", "C. Muller", "C Muller", "Charl. Muller", "Ted Muller", "Anthony Muller")] == [False, True, True, True, True, False]
