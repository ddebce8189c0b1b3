"""Held-out items that are long, or stand in a document many times."""

import random

import pytest

from ledgerloom.llm import leakage


def fresh(rng, n):
    return ["".join(rng.choices("abcdefghiklmnoprstuvw", k=7)) for _ in range(n)]


@pytest.mark.parametrize("length", [250, 1900, 2100, 6000])
@pytest.mark.parametrize("edited", [False, True])
def test_long_items_are_found(length, edited):
    rng = random.Random(length)
    items = [fresh(rng, length), fresh(rng, 100), fresh(rng, length)]
    index = leakage.Index([(n, " ".join(w)) for n, w in enumerate(items)])
    held = [w if not edited or k % 6 else "zz" for k, w in enumerate(items[0])]
    half = held[length // 4 : length // 4 + length // 2]
    for words in (held, fresh(rng, 95) + held + fresh(rng, 30), fresh(rng, 37) + half + fresh(rng, 50)):
        assert leakage.leaks_of(" ".join(words), index) == [0]
    assert leakage.leaks_of(" ".join(held[: length // 3]), index) == []


@pytest.mark.parametrize("times", [1, 11, 12, 13, 40])
def test_second_stretch_is_paired_however_often_the_first_stands(times):
    rng = random.Random(times)
    items = [fresh(rng, 100) for _ in range(3)]
    index = leakage.Index([(n, " ".join(w)) for n, w in enumerate(items)])
    quoted = [w for _ in range(times) for w in items[0][5:33] + fresh(rng, 20)]
    words = fresh(rng, 30) + quoted + items[0][60:76] + fresh(rng, 40)
    assert leakage.leaks_of(" ".join(words), index) == [0]
    assert leakage.leaks_of(" ".join(fresh(rng, 30) + items[0][60:76] + quoted), index) == []


def test_best_two_equals_all_pairs():
    rng = random.Random(8)
    for _ in range(500):
        runs = []
        for _ in range(rng.randrange(30)):
            j, i = rng.randrange(60), rng.randrange(30)
            runs.append((rng.randrange(5, 20), (j, i), (j + rng.randrange(1, 12), i + rng.randrange(1, 12))))
        pairs = [a[0] + b[0] for a in runs for b in runs if a[2][0] < b[1][0] and a[2][1] < b[1][1]]
        assert leakage.best_two(runs) == max([*pairs, *[r[0] for r in runs]], default=0)


def test_blocks_find_what_one_index_finds(spark, monkeypatch):
    rng = random.Random(4)
    phrase = fresh(rng, 45)
    items = [(n, " ".join(phrase + fresh(rng, 55))) for n in range(30)] + [(n, " ".join(fresh(rng, 20 + n))) for n in range(30, 40)]
    held = spark.createDataFrame(items, "item_id bigint, text string")
    docs = spark.createDataFrame([(n, " ".join(fresh(rng, 40)) + " " + t) for n, t in items] + [(99, " ".join(fresh(rng, 30) + phrase + fresh(rng, 30)))], "doc_id bigint, text string")
    want = {tuple(r) for r in leakage.leaks(docs, held).collect()}
    assert {(n, n) for n, _ in items} <= want
    monkeypatch.setattr(leakage, "ITEMS_PER_BLOCK", 7)
    assert {tuple(r) for r in leakage.leaks(docs, held).collect()} == want
