"""Order documents derived from the star schema: ground truth, and predictions under other names and formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.tables import table

#: Truth: field name and its value as JSON text, as expressions over orders and customer.
TRUTH = [
    ("po_number", "concat('\"PO-', o_orderkey, '\"')"),
    ("order_date", "concat('\"', date_format(o_orderdate, 'yyyy-MM-dd'), '\"')"),
    ("buyer_name", "concat('\"', c_name, '\"')"),
    ("total_amount", "cast(cast(o_totalprice as decimal(18,2)) as string)"),
    ("payment_terms", "concat('\"', o_orderpriority, '\"')"),
    ("currency", "'\"USD\"'"),
    ("line_items", "concat('[{\"sku\":\"A', o_orderkey, '\",\"price\":', cast(o_totalprice as decimal(18,2)), '},{\"sku\":\"B\",\"price\":2.5}]')"),
]
#: Predicted lists: in other order and case, as JSON text with numbers as text, too short, or an object.
ITEMS = """case o_orderkey % 4
    when 0 then concat('[{"price":', cast(o_totalprice as decimal(18,2)), ',"sku":"a', o_orderkey, '"}, {"sku":" B ","price":"2.50"}]')
    when 1 then concat('"[{\\\\"sku\\\\":\\\\"A', o_orderkey, '\\\\",\\\\"price\\\\":\\\\"$', format_number(o_totalprice, 2), '\\\\"},{\\\\"sku\\\\":\\\\"B\\\\",\\\\"price\\\\":2.5}]"')
    when 2 then concat('[{"sku":"A', o_orderkey, '","price":', cast(o_totalprice as decimal(18,2)), '}]')
    else concat('{"sku":"A', o_orderkey, '","price":', cast(o_totalprice as decimal(18,2)), '}') end"""
#: Predictions: order, name as typed, value, and the condition under which the field is there.
PREDICTED = [
    (0, "PO No", "concat('\"PO-', o_orderkey, '\"')", "o_orderkey % 11 != 0"),
    (1, "PO Date", "concat('\"', case when o_orderkey % 2 = 0 then date_format(o_orderdate, 'd/M/yyyy') else date_format(o_orderdate, 'dd/MM/yy') end, '\"')", "o_orderkey % 7 != 0"),
    (2, "ship-to", "concat('\"  ', upper(c_name), ' \"')", "true"),
    (3, "Grand-Total", "case when o_orderkey % 5 = 0 then '1.5' else concat('\"$', format_number(o_totalprice, 2), '\"') end", "true"),
    (4, "total", "cast(cast(o_totalprice as decimal(18,2)) as string)", "o_orderkey % 17 = 0"),
    (5, "terms", "case when o_orderkey % 13 = 0 then 'null' else concat('\"', lower(o_orderpriority), '\"') end", "true"),
    (6, "mystery_field", "'\"?\"'", "o_orderkey % 4 = 0"),
    (7, "Line-Items", ITEMS, "o_orderkey % 3 != 0"),
]


def orders(spark: SparkSession, folder: str) -> DataFrame:
    named = table(spark, folder, "customer", "c_custkey", "c_name")
    return table(spark, folder, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderpriority").join(named, F.col("o_custkey") == F.col("c_custkey"))


def long_form(rows: DataFrame, fields: list[tuple[int, str, str, str]]) -> DataFrame:
    made = [F.when(F.expr(there), F.struct(F.lit(ord_).cast("bigint").alias("ord"), F.lit(name).alias("name"), F.expr(value).alias("value_json"))) for ord_, name, value, there in fields]
    return rows.select(F.col("o_orderkey").alias("doc_id"), F.lit("po").alias("doc_type"), F.explode(F.array_compact(F.array(*made))).alias("f")).select("doc_id", "doc_type", "f.*")


def truth(spark: SparkSession, folder: str) -> DataFrame:
    return long_form(orders(spark, folder), [(n, name, value, "true") for n, (name, value) in enumerate(TRUTH)])


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    return long_form(orders(spark, folder), PREDICTED)
