"""Bounded training samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockloom.llm.text import held_out


CELLS = 8  # steps of the id hashes for each doubling


def first_by_hash(rows: DataFrame, group: str, most: int | Column) -> DataFrame:
    """Of each value of ``group`` the ``most`` rows with the smallest hashes of ``_id``; no nulls in either column.

    Rows are counted by group and step of the logarithm of the hash, at most 53 * CELLS steps a group. Only rows up to the step
    where a group is full are ranked: some tenth more than are taken, however large the group and however many its partitions.
    """
    most = F.lit(most) if isinstance(most, int) else most
    cell = F.floor(CELLS * F.log2(F.shiftright("_hash", 11) + F.lit(2**52 + 1))).cast("int")
    drawn = rows.withColumn("_hash", F.xxhash64("_id")).withColumn("_cell", cell)
    reach = F.sum("_n").over(Window.partitionBy(group).orderBy("_cell"))
    ends = drawn.groupBy(group, "_cell").agg(F.count("*").alias("_n")).withColumn("_reach", reach).where(F.col("_reach") >= most)
    ends = ends.groupBy(group).agg(F.min("_cell").alias("_last"))  # a row for each group that has more rows than are taken
    close = drawn.join(F.broadcast(ends), group, "left").where(F.col("_last").isNull() | (F.col("_cell") <= F.col("_last")))
    ranked = close.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy("_hash", "_id"))).where(F.col("_r") <= most)
    return ranked.select(rows.columns)


def _known(labels: DataFrame, targets: list[str], id_col: str) -> DataFrame:
    known = labels.select(F.col(id_col).cast("long").alias("_id"), *targets).dropna()
    return known.where(~held_out("_id")).groupBy("_id").agg(*(F.max(t).alias(t) for t in targets))


def _with_texts(docs: DataFrame, picked: DataFrame, targets: list[str], id_col: str, text_col: str) -> DataFrame:
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("text"))
    got = texts.join(F.broadcast(picked), "_id").groupBy("_id", *targets).agg(F.max("text").alias("text"))
    return got.select("_id", "text", *targets)


def labelled_sample(docs: DataFrame, labels: DataFrame, targets: list[str], max_rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(_id, text, targets...)`` of at most ``max_rows`` labelled documents that are not held out.

    The sample is the documents with the smallest id hashes, so it does not depend on partitions. Labels with
    nulls are left out; of several labels of one id, and of several texts of one id, the largest counts.
    The broadcast side has ``max_rows`` rows at most, without texts.
    """
    picked = first_by_hash(_known(labels, targets, id_col).withColumn("_all", F.lit(0)), "_all", max_rows)
    return _with_texts(docs, picked.drop("_all"), targets, id_col, text_col)


def label_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, dict[int, float]]:
    """As ``labelled_sample`` for one label of 0 and 1, but of each value those with the smallest id hashes: all of a value
    with no more than half of ``max_rows``, the rest from the other. Also the share of the rows of each value that is taken."""
    known = _known(labels, [label], id_col).withColumn(label, F.col(label).cast("int"))
    count = {0: 0, 1: 0} | {int(r[label]): r["count"] for r in known.groupBy(label).count().collect()}
    take = {v: min(count[v], max(max_rows // 2, max_rows - count[1 - v])) for v in (0, 1)}
    picked = first_by_hash(known.where(F.col(label).isin(0, 1)), label, F.when(F.col(label) == 1, take[1]).otherwise(take[0]))
    return _with_texts(docs, picked, [label], id_col, text_col), {v: take[v] / max(count[v], 1) for v in (0, 1)}
