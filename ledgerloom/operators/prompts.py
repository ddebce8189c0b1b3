"""Prompts as columns, few-shot selection, and the strict form of JSON schemas."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ledgerloom.functions.normalize import strip

#: Characters of compact JSON of examples per prompt, and examples per document type.
BUDGET, EXAMPLES = 1500, 5


def few_shot_budget(examples: DataFrame, limit: int = EXAMPLES, budget: int = BUDGET) -> DataFrame:
    """Per doc_type the first examples in file order whose sizes add up to the budget; the first always stays."""
    order = Window.partitionBy("doc_type").orderBy("file")
    sized = examples.withColumns({"turn": F.row_number().over(order), "used": F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    return sized.filter((F.col("turn") <= limit) & ((F.col("turn") == 1) | (F.col("used") <= budget)))


@F.pandas_udf(T.LongType())
def example_size(output: pd.Series) -> pd.Series:
    """The length of an example's output as compact JSON under the key `fields`, as it stands in a prompt; null where the output is no object or holds nothing."""

    def size(text: str | None) -> int | None:
        try:
            fields = json.loads(text) if text else None
        except (ValueError, RecursionError):
            return None
        return len(json.dumps({"fields": fields}, ensure_ascii=False, separators=(",", ":"))) if isinstance(fields, dict) and fields else None

    return pd.Series([size(t) for t in output], dtype="Int64")


def with_text(parts: list[Column], text: Column, label: str = "Document text:\n") -> Column:
    """Prompt parts joined by blank lines, with the document's text last where it is not blank."""
    body = F.when(F.coalesce(strip(text), F.lit("")) != "", F.concat(F.lit(label), strip(text)))
    return F.concat_ws("\n\n", *parts, body)


def router_prompt(filename: Column, text: Column, allowed: list[str] | None = None) -> Column:
    """A classification prompt: free types, or one of the allowed ones."""
    task = "Name the type of this document in your own words." if allowed is None else f"Name the type of this document, exactly one of: {', '.join(allowed)}."
    parts = [F.lit(task), F.lit("Name its language: en, th, or other."), F.lit("Propose the fields that can be read in it, each with a short name and a description."), F.concat(F.lit("Filename: "), filename)]
    return with_text(parts, text)


def extractor_prompt(suggested: Column, text: Column, examples: Column) -> Column:
    """Suggested fields (a map of name to description) as JSON, examples where there are any, and the text."""
    parts = [F.lit("Read these fields from the document."), F.to_json(suggested, {"pretty": "true"}), F.when(F.coalesce(examples, F.lit("")) != "", F.concat(F.lit("Examples:\n"), examples))]
    return with_text(parts, text)


def judge_prompt(predicted: Column, text: Column) -> Column:
    """S18."""
    return with_text([F.lit("Score how well these values fit the document, from 0 to 1."), F.to_json(predicted, {"pretty": "true"})], text, "Source text:\n")


def has_input(text: Column, image: Column) -> Column:
    """C4: a stage needs text that is not blank, or an image."""
    return (F.coalesce(strip(text), F.lit("")) != "") | image.isNotNull()


def strict_schema(schema: dict) -> dict:
    """Every object closed and all of its members required; members without a type take any scalar or list of scalars."""
    scalars = ["string", "number", "boolean", "null"]

    def closed(node, root: bool = False):
        if isinstance(node, list):
            return [closed(x) for x in node]
        if not isinstance(node, dict):
            return node
        out = {k: closed(v) for k, v in node.items() if not (root and k == "title")}
        if isinstance(out.get("properties"), dict):
            out["properties"] = {k: typed(v) for k, v in out["properties"].items()}
            out["required"] = list(out["properties"])
            out["additionalProperties"] = False
        return out

    def typed(node):
        if isinstance(node, dict) and not {"type", "anyOf", "$ref", "enum", "allOf", "oneOf"} & node.keys():
            return node | {"anyOf": [{"type": t} for t in scalars] + [{"type": "array", "items": {"anyOf": [{"type": t} for t in scalars]}}]}
        return node

    return closed(schema, True)
