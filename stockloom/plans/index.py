"""Dense positions over a whole table without a window over all of its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SPAN = 4096


def offsets(rows: DataFrame, key: str, span: int = SPAN) -> DataFrame:
    """``(key, before)``: for each value of a whole-number key the rows with smaller ones.

    Rows are counted by key, then by spans of keys; only the spans are summed in one place, and the keys of a span in its own.
    """
    per = rows.groupBy(key).agg(F.count("*").alias("_n")).withColumn("_span", F.floor(F.col(key) / span))
    spans = per.groupBy("_span").agg(F.sum("_n").alias("_s"))
    base = spans.select("_span", (F.sum("_s").over(Window.orderBy("_span")) - F.col("_s")).alias("_base"))
    within = F.sum("_n").over(Window.partitionBy("_span").orderBy(key)) - F.col("_n")
    return per.withColumn("_in", within).join(base, "_span").select(key, (F.col("_base") + F.col("_in")).cast("long").alias("before"))
