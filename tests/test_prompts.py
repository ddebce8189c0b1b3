"""Prompts and few-shot examples against plain Python, where the SQL leaves something out."""

import json

import pytest

from ledgerloom.plans import queries

TASK = ["Name the type of this document, exactly one of: invoice, po, delivery_note.", "Name its language: en, th, or other.", "Propose the fields that can be read in it, each with a short name and a description."]
TEXTS = [None, "", " \t\r\n", "plain", "  a\nb \n", "ใบแจ้งหนี้ ๑๒", " é　", "a\tb\r\n", "\x1c\x85x ", "​x​", "🎉é", "﻿x", "\x00x\x7f", "x" * 5000 + "ก"]


@pytest.fixture
def folder(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_router_prompt_sizes_every_document(spark, folder):
    want = {}
    for n, text in enumerate(TEXTS):
        body = (text or "").strip()
        want[n] = (body != "", len("\n\n".join([*TASK, f"Filename: doc_{n}", *["Document text:\n" + body] * (body != "")])))
    assert {r.doc_id: (r.has_input, r.n_chars) for r in queries.router_prompt(spark, folder).collect()} == want


OUTPUTS = [
    '{"a":  "%s", "b": null}' % ("x" * 690),
    '{ "ก": "\\u0e01\\/", "n": [1.0, 1e3, 12345678901234567890123, null], "a": 1, "a": 2 }' + " " * 500,
    "broken",
    "{}",
    "[1, 2]",
    None,
    '{"q": "\\n\\u0001🎉", "deep": {"x": [ {}, [] ]}, "long": "%s"}' % ("y" * 600),
    '{"last":   "%s"}' % ("z" * 20),
    '{"over":   "%s"}' % ("z" * 900),
]


def test_few_shot_budget_sizes_compact_json(spark, tmp_path):
    for name, rows in (("invoices", OUTPUTS), ("purchase_orders", OUTPUTS[:1]), ("delivery_notes", OUTPUTS[8:] * 2)):
        spark.createDataFrame([(f"f{n}", "s", o) for n, o in enumerate(rows)], "file_stem string, source_system string, output string").write.parquet(f"{tmp_path}/{name}.parquet")
    want = set()
    for kind, rows in (("invoice", OUTPUTS), ("po", OUTPUTS[:1]), ("delivery_note", OUTPUTS[8:] * 2)):
        used = turn = 0
        for n, output in enumerate(rows):
            try:
                fields = json.loads(output or "null")
            except ValueError:
                continue
            if not isinstance(fields, dict) or not fields:
                continue
            size, turn = len(json.dumps({"fields": fields}, ensure_ascii=False, separators=(",", ":"))), turn + 1
            used += size
            if turn > 5 or turn > 1 and used > 1500:
                break
            want.add((f"{kind}/s", f"f{n}", size, turn, used))
    assert {f for k, f, *_ in want if k == "invoice/s"} == {"f0", "f1", "f6", "f7"}
    assert {tuple(r) for r in queries.few_shot_budget(spark, str(tmp_path)).collect()} == want
