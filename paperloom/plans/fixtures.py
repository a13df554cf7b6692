"""The domain's roles on the star-schema tables: orders are invoices, line items their rows, events runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import values as V
from paperloom.operators.fields import Fields
from paperloom.settings import DEFAULT, Settings

ITEM_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their line items as one sorted array; an order without items has an empty one."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct(*ITEM_ORDER).alias("item"))
    listed = items.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("item")).alias("items"))
    orders = table(spark, sf_dir, "orders")
    joined = orders.join(listed, F.col("o_orderkey") == F.col("l_orderkey"), "left").drop("l_orderkey")
    empty = F.array().cast(joined.schema["items"].dataType)
    return joined.withColumn("items", F.coalesce("items", empty))


def invoice_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the sum and the number of their line items: no more columns, and no arrays, for rules that need no more."""
    sums = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("item_sum"), F.count(F.lit(1)).alias("n_items"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    return orders.join(sums, F.col("o_orderkey") == F.col("l_orderkey"), "left").drop("l_orderkey")


def total_fields(settings: Settings = DEFAULT) -> Fields:
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return Fields(values={"total": V.Number("o_totalprice"), "invoice_date": V.Text(day), "item_sum": V.Number(F.coalesce("item_sum", F.lit(0.0)))}, settings=settings)


def invoice_fields(settings: Settings = DEFAULT) -> Fields:
    row = lambda x: F.struct(V.number(x["l_quantity"]).alias("qty"), V.number(x["l_extendedprice"]).alias("amount"), V.text(x["l_returnflag"]).alias("flag"))
    first = F.try_element_at("items", F.lit(1))
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return Fields(
        values={
            "invoice_no": V.Number("o_orderkey"), "vendor": V.Number("o_custkey"), "total": V.Number("o_totalprice"),
            "invoice_date": V.Text(day), "doc_type": V.Text("o_orderpriority"), "status": V.Text("o_orderstatus"),
            "first_amount": V.Number(first["l_extendedprice"]), "first_tax": V.Number(first["l_tax"]),
            "ship_date": V.Text(F.date_format(first["l_shipdate"], "yyyy-MM-dd")), "return_flag": V.Text(first["l_returnflag"]),
            "item_sum": V.Number(F.aggregate("items", F.lit(0.0), lambda a, x: a + x["l_extendedprice"])),
            "has_items": V.Bool(F.size("items") > 0),
        },
        lists={"line_items": F.transform("items", row), "signatures": F.transform("items", lambda x: V.boolean(x["l_linestatus"] == "F"))},
        composite=frozenset({"line_items"}), settings=settings,
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a run log: doc_id, seq, stage, ts, confidence between 0 and 1."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("doc_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("stage"), "ts",
        (F.col("value") / 500).alias("confidence"), F.get_json_object("props", "$.k").cast("long").alias("k"),
    )


#: The same in SQL, to be put before an oracle query.
INVOICES = """
WITH inv AS (
    SELECT o.*, i.n_items, coalesce(i.item_sum, 0.0) AS item_sum, i.items FROM orders o LEFT JOIN (
        SELECT l_orderkey, count(*) AS n_items, sum(l_extendedprice) AS item_sum,
               list({'amount': l_extendedprice, 'qty': l_quantity, 'tax': l_tax, 'flag': l_returnflag, 'ship': l_shipdate, 'state': l_linestatus}
                    ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS items
        FROM lineitem GROUP BY l_orderkey) i ON o.o_orderkey = i.l_orderkey)
"""
RUNS = "WITH runs AS (SELECT user_id AS doc_id, event_id AS seq, event_type AS stage, ts, value / 500 AS confidence, (props->>'$.k')::BIGINT AS k FROM events)"
