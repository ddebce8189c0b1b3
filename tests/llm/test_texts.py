import itertools
import math
import random

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.llm import canonical, leakage, quality, tokens

WORDS = [f"{a}{b}{c}" for a, b, c in itertools.product(("bro", "cla", "dri", "fen", "gol"), ("ma", "ne", "ti", "po"), ("ck", "rn", "st"))]


@pytest.fixture(scope="module")
def encoder():
    return tokens.encoder(tokens.vocabulary_file(), tokens.vocabulary_pattern())


@pytest.fixture(scope="module")
def reference(encoder):
    return tiktoken.Encoding("own", pat_str=tokens.vocabulary_pattern(), mergeable_ranks=encoder.ids, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(text=st.text(max_size=80))
def test_tokens_equal_another_implementation(encoder, reference, text):
    assert encoder.encode(text) == reference.encode_ordinary(text)


@pytest.mark.parametrize("text", ["", " ", "a" * 3000, "<|endoftext|>", " \n\t" * 400, "ก" * 700, "🎉👩‍👩‍👧é", "it's we'll I'VE"])
def test_token_edges(encoder, reference, text):
    assert encoder.encode(text) == reference.encode_ordinary(text)
    assert b"".join(encoder.by_id[i] for i in encoder.encode(text)).decode() == text


@settings(max_examples=100, deadline=None)
@given(old=st.binary(max_size=30), new=st.binary(max_size=30))
def test_appends_and_edits_reuse_prefixes(encoder, old, new):
    table = encoder.extend([-1], old, 0)
    assert encoder.read(encoder.reencode(old, list(table), new)) == encoder.merge(new)
    assert encoder.read(encoder.extend(list(table), old + new, len(old))) == encoder.merge(old + new)


def test_tokens_of_null(spark):
    frame = spark.createDataFrame([(1, None, 9), (2, "", 9), (3, " ", 9), (3, " ", 9)], "doc_id bigint, text string, ids int")
    got = sorted(tuple(r) for r in tokens.encode_texts(frame, "doc_id", "text", tokens.vocabulary_file(), tokens.vocabulary_pattern()).collect())
    assert got == [(1, []), (2, []), (3, [220]), (3, [220])]


def sentence(rng, n):
    return [rng.choice(WORDS) for _ in range(n)]


def leak_cases():
    rng = random.Random(5)
    items = {i: sentence(rng, 100) for i in range(40)}
    documents, want = {}, set()
    for d in range(60):
        words, kind, i = sentence(rng, 300), d % 6, d % 40
        item = items[i]
        if kind == 0:
            words[50:50] = item
        elif kind == 1:
            words[20:20] = item[:25]
            words[200:200] = item[60:85]
        elif kind == 2:
            part = item[30:85]
            words[90:90] = [w[:-1] + "x" if k % 9 == 4 else w for k, w in enumerate(part)]
        elif kind == 3:
            words[90:90] = item[:20]
        elif kind == 4:
            words[20:20] = item[60:80]
            words[200:200] = item[:19]
        if kind < 3:
            want.add((d, i))
        text = " ".join(words)
        documents[d] = text.upper() if d % 4 == 0 else text.replace(" ", "\n> ", 40) if d % 4 == 1 else text
    return items, documents, want


def test_leaks_found_and_nothing_else(spark):
    items, documents, want = leak_cases()
    rows = [*documents.items(), (500, None), (501, ""), (502, "short text")]
    docs = spark.createDataFrame([*rows, rows[0]], "doc_id bigint, text string")
    held = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()] + [(900, None), (901, "")], "item_id bigint, text string")
    assert {tuple(r) for r in leakage.leaks(docs, held).collect()} == want
    assert leakage.leaks(docs.limit(0), held).count() == 0 and leakage.leaks(docs, held.limit(0)).count() == 0


def test_wand_finds_all_above_the_threshold():
    items, documents, _ = leak_cases()
    index = leakage.Index([(i, " ".join(w)) for i, w in items.items()])
    for text in documents.values():
        query = {index.number[g] for g in leakage.grams(leakage.words_of(text))[:120] if g in index.number}
        scores = {}
        for gram in query:
            for n, w in list(zip(*index.postings[gram][:2], strict=True))[:-1]:
                scores[n] = scores.get(n, 0.0) + w
        assert index.search(list(query)) == {n for n, s in scores.items() if s >= 1}


def test_wand_on_long_lists():
    """Lists of many blocks, with weights that reach the threshold in few of them only."""
    rng = random.Random(11)
    index = leakage.Index([(0, "a b c")])
    for trial in range(300):
        index.postings, scores = [], {}
        for _ in range(rng.randrange(1, 12)):
            docs = sorted(rng.sample(range(400), rng.randrange(1, 200)))
            weights = [rng.choice((0.05, 0.1, 0.1, 0.6)) for _ in docs]
            blocks = range(0, len(docs), leakage.BLOCK)
            index.postings.append(([*docs, leakage.END], [*weights, 0.0], [*(max(weights[k : k + leakage.BLOCK]) for k in blocks), 0.0], [*(docs[min(k + leakage.BLOCK, len(docs)) - 1] for k in blocks), leakage.END], max(weights)))
            for n, w in zip(docs, weights, strict=True):
                scores[n] = scores.get(n, 0.0) + w
        unsure = {n for n, s in scores.items() if abs(s - 1) < 1e-6}
        assert index.search(list(range(len(index.postings)))) - unsure == {n for n, s in scores.items() if s >= 1} - unsure, trial


def test_short_items_and_short_documents():
    rng = random.Random(3)
    items = {1: "alpha bravo carol delta emily frank", 2: "zulu yankee", 3: "xray", 4: "one two three"} | {n: " ".join(sentence(rng, 90)) for n in range(10, 200)}
    index = leakage.Index(list(items.items()))
    cases = {"Alpha, bravo carol delta - emily frank": [1], "zulu yankee": [2], "the yankee zulu": [], "an XRAY here": [3], "one two three": [4], "one two": [], "alpha bravo carol": [], "": [], "zulu yankee one two three xray": [2, 3, 4]}
    assert {text: sorted(leakage.leaks_of(text, index)) for text in cases} == cases
    assert leakage.leaks_of(" ".join(sentence(rng, 200)) + " zulu yankee", index) == [2]


def test_items_that_share_all_their_words_are_found():
    rng = random.Random(4)
    same = " ".join(sentence(rng, 60))
    index = leakage.Index([(n, same) for n in range(50)] + [(n, " ".join(sentence(rng, 60))) for n in range(50, 60)])
    assert sorted(leakage.leaks_of("before " + same + " after", index)) == list(range(50))


def test_question_and_answer_are_told_apart():
    rng = random.Random(6)
    question, answer = sentence(rng, 40), sentence(rng, 40)
    index = leakage.Index([(1, "Question: " + " ".join(question) + "? Answer: " + " ".join(answer)), (2, " ".join(sentence(rng, 80)))])
    (item, whole, asked, told), = leakage.overlaps(" ".join([*sentence(rng, 50), *answer, *sentence(rng, 50)]), index)
    assert item == 1 and 0.4 <= whole <= 0.6 and asked < 0.3 and told > 0.9


def test_text_types(spark):
    prose = "The clerk counted the crates before the lorry came, and the driver signed the slip. After that they all went home."
    cases = {
        "prose": [prose, prose.lower().replace(".", ""), "ก่อนสิ้นเดือนพนักงานรับของจดบันทึกกล่องแก้วสองใบก่อนที่รถจะออกจากลาน และตรวจดูยอดค้างชำระเพราะยอดรวมไม่ตรงกัน"],
        "list": ["Contents\n- wood screws\n- tea tins x3\n- desk lamps\n- pump seals", "1. glass jars\n2. 4 zip ties\n3. floor wax\n4. lamp shades"],
        "table": ["No\tDate\tQty\tAmount\n1\t01/02/2024\t5\t1,200.00\n2\t03/02/2024\t7\t90.10\n3\t04/02/2024\t7\t91.10", "| 1 | a | 20 | 3.50 |\n|---|---|---|---|\n| 2 | b | 30 | 4.50 |\n| 3 | c | 31 | 4.60 |"],
        "junk": ["<div class=c><td></td><br/><span id=s2>&nbsp;</span><td></td></div>" * 4, "asdf asdfasdf qwer zxcv jkl; fdsa hjkl asdf", "scan error 41\n" * 12],
    }
    rows = [(f"{form}{i}{k}", text, form) for form, texts in cases.items() for i, text in enumerate(texts) for k in range(20 if form == "prose" else 6)]
    frame = spark.createDataFrame([*rows, ("e1", None, "empty"), ("e2", "", "empty"), ("e3", " \n ", "empty")], "doc_id string, text string, want string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0].endswith("0")], "doc_id string, form string")
    got = quality.text_types(frame.select("doc_id", "text"), "doc_id", "text", labels).join(frame.select("doc_id", "want"), "doc_id")
    assert [(r.doc_id, r.form) for r in got.filter("form != want").collect()] == []
    assert quality.text_types(frame.select("doc_id", "text").limit(0), "doc_id", "text").count() == 0


def test_statistics_of_known_text(spark):
    frame = spark.createDataFrame([("a", "One two, two.\n- x 12\n\n", 1)], "k string, t string, n_words int")
    row = quality.statistics(frame, "k", "t").first()
    assert (row.n_words, row.n_distinct, row.n_lines, row.n_marked, row.n_digits, row.n_closed, row.n_doubled) == (4, 3, 2, 1, 2, 1, 1)


def brute(values, phrases, threshold):
    best = {}
    for kind, value in values:
        a = set(canonical.pairs_of(value))
        for kind_, phrase, term in phrases:
            b = set(canonical.pairs_of(phrase))
            s = len(a & b) / max(1, len(a | b))
            if kind == kind_ and s >= threshold and a:
                best[kind, value] = max(best.get((kind, value), (0, 0)), (s, -term))
    return {k: -t for k, (s, t) in best.items()}


def test_join_equals_all_pairs(spark):
    rng = random.Random(2)
    phrases = [(kind, " ".join(rng.sample(WORDS[:25], 2)), n) for n, kind in enumerate("ab" * 30, 1)]
    values = set()
    for kind, phrase, _ in phrases:
        letters = list(phrase)
        k = rng.randrange(1, len(letters) - 1)
        letters[k], letters[k - 1] = letters[k - 1], letters[k]
        values |= {(kind, "".join(letters)), (kind, phrase.title().replace(" ", "")), (kind, " ".join(rng.sample(WORDS, 2)))}
    got = canonical.map_values(spark.createDataFrame(sorted(values), "list string, value string"), spark.createDataFrame(phrases, "list string, phrase string, term_id bigint"), 0.5)
    assert {(r.list, r.value): r.term_id for r in got.collect()} == brute(values, phrases, 0.5)


def test_map_column_keeps_all_rows(spark):
    rows = spark.createDataFrame([("a", "x y", 1), ("a", "x y", 1), (None, "z", 2), ("a", "Name", 3), ("a", "name", 4), ("b", "name", 5)], "list string, value string, row_id bigint")
    phrases = spark.createDataFrame([("a", "name", 7)], "list string, phrase string, term_id bigint")
    names = phrases.withColumnRenamed("phrase", "value")
    got = sorted((r.row_id, r.term_id, r.exact) for r in canonical.map_column(rows, phrases, names).collect())
    assert got == [(1, 0, False), (1, 0, False), (2, 0, False), (3, 7, False), (4, 7, True), (5, 0, False)]
    assert canonical.map_column(rows.limit(0), phrases, names).count() == 0
