"""Results written out: responses as JSON lines, and the fields of a page as one JSON object."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def response_json(pages: DataFrame, group: str, order: list[str]) -> DataFrame:
    """IO11: per group one JSON text of its pages in order, nulls kept: group, response."""
    rows = pages.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(*order, F.struct(*[c for c in pages.columns if c != group]).alias("_page")))).alias("_rows"))
    return rows.select(group, F.to_json(F.struct(F.col(group).alias("request"), F.transform("_rows", lambda r: r["_page"]).alias("documents")), {"ignoreNullFields": "false"}).alias("response"))


def write_responses(responses: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """IO11: JSON lines under `path`, one file per task; an existing folder is an error unless `mode` says otherwise."""
    responses.select("response").write.mode(mode).text(path)


def export_fields(fields: DataFrame, pretty: bool = True) -> DataFrame:
    """IO12: the fields (doc_id, field, value_json) of each document as one JSON object, fields in name order: doc_id, exported."""
    rows = fields.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("field", "value_json"))).alias("_f"))
    line: Column = F.transform("_f", lambda f: F.concat(F.to_json(F.array(f["field"])), F.lit(": " if pretty else ":"), F.coalesce(f["value_json"], F.lit("null"))))
    line = F.transform(line, lambda x: F.regexp_replace(x, r'^\[(".*?(?<!\\\\)(?:\\\\\\\\)*")\]', "$1"))
    body = F.concat_ws(",\n  " if pretty else ",", line)
    return rows.select("doc_id", F.concat(F.lit("{\n  " if pretty else "{"), body, F.lit("\n}" if pretty else "}")).alias("exported"))
