"""Records nested deeper than json reads, and the reading for them against json."""

import json

import pytest

from ledgerloom.operators import nested

TEXTS = ['{"a": [1, 2.50, -3e5, {"b": null, "b": true}], "ก": "\\u0e01\\n", "e": {}, "f": [], "n": NaN, "i": -Infinity}', "[]", " 7 ", '"x"', "", " ", "[1,]", '{"a":1,}', '{"a" 1}', '{"a":1} x', "[1 2]", "{1:2}", "[", '{"a":', "tru", "01", '"\t"', "]", "[}", "﻿[]", "-", "1."]


@pytest.mark.parametrize("text", TEXTS)
def test_deep_reading_equals_json(text):
    want = nested.decode(text)
    got = nested.decode_deep(text)
    assert repr(got) == repr(want)
    if want is not None:
        assert nested.encode_deep(got) == json.dumps(nested.plain(want), ensure_ascii=False)


@pytest.mark.parametrize("depth", [10, 3_000, 50_000])
def test_records_of_any_depth(depth):
    text = '{"items": [' + '{"sub_items": [' * depth + '{"total": 7}' + "]}" * depth + "]}"
    rows = 0
    for path, *_, key, value in nested.triples(text):
        rows += key is None
        if rows > 2_000:
            break  # the paths grow with the depth
    assert rows == min(depth + 1, 2_001)


def test_deep_value_of_a_field():
    text = '{"items": [{"note": ' + "[" * 50_000 + "]" * 50_000 + ', "total": 7}]}'
    values = {t[4]: t[5] for t in nested.triples(text)}
    assert values["total"] == "7" and values["note"] == "[" * 50_000 + "]" * 50_000
