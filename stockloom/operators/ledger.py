"""The relational side: stock lines, suggestions, event-sourced state, review, gates."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockloom.operators.graph import connected_components


def stock_lines(groups: DataFrame, manual: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Counted units and manual lines summed per product. total_units = full_cases * units_per_case + loose_units.

    groups: code, units; manual: code, full_cases, loose_units. Products without a catalogue row keep no line.
    """
    upc = F.col("units_per_case")
    by_hand = manual.join(catalogue.select("code", "units_per_case"), "code").select("code", (F.col("full_cases") * upc + F.col("loose_units")).alias("units"))
    total = groups.select("code", "units").unionByName(by_hand).groupBy("code").agg(F.sum("units").cast("long").alias("total_units"))
    return total.join(catalogue, "code").withColumn("full_cases", F.expr("total_units div units_per_case")).withColumn("loose_units", F.expr("total_units % units_per_case"))


def zero_lines(catalogue: DataFrame, counts: DataFrame) -> DataFrame:
    """Every product of the catalogue, 0 where nothing was counted."""
    return catalogue.join(counts, "code", "left").withColumn("total_units", F.coalesce("total_units", F.lit(0)).cast("long"))


def suggestions(groups: DataFrame, by_case: DataFrame, by_print: DataFrame) -> DataFrame:
    """The suggested product of each group: case barcode before the nearest taught example before none; never assigned silently.

    by_case: case_gtin, code (several codes for one barcode: the smallest); by_print: group_id, code.
    """
    one = by_case.groupBy("case_gtin").agg(F.min("code").alias("case_code"))
    out = groups.join(one, "case_gtin", "left").join(by_print.withColumnRenamed("code", "print_code"), "group_id", "left")
    source = F.when(F.col("case_code").isNotNull(), "case").when(F.col("print_code").isNotNull(), "taught").otherwise("none")
    return out.withColumn("suggested", F.coalesce("case_code", "print_code")).withColumn("source", source).withColumn("exported", F.when(F.col("confirmed"), F.col("suggested")))


def latest_state(events: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """The last values of each key in an append-only log."""
    return events.groupBy(key).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_s")).select(key, *(F.col(f"_s.{v}").alias(v) for v in values))


LIFECYCLE = {("open", "finish"): "review", ("review", "lock"): "locked", ("review", "resume"): "open", ("locked", "reopen"): "review"}


def lifecycle_errors(events: DataFrame, key: str, order: list[str], action: str) -> DataFrame:
    """Actions that a session's state did not allow, with that state. A refused action leaves the state as it is; sessions begin open.

    Rows are dealt by session and sorted; one state goes from row to row, so that memory does not follow a session's length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session, state = object(), "open"
        for batch in batches:
            states, refused = [], []
            for k, a in zip(batch.column(key).to_pylist(), batch.column(action).to_pylist(), strict=True):
                if k != session:
                    session, state = k, "open"
                states.append(state)
                after = LIFECYCLE.get((state, a))
                refused.append(after is None)
                state = after or state
            yield batch.append_column("state", pa.array(states, pa.string())).filter(pa.array(refused, pa.bool_()))

    rows = events.repartition(key).sortWithinPartitions(key, *order)
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("state", T.StringType())]))


def overlapping_sessions(sessions: DataFrame, device: str, start: str, end: str) -> DataFrame:
    """Sessions that begin while an earlier one of their device is still open: each device may have one active session."""
    earlier = Window.partitionBy(device).orderBy(start, "session").rowsBetween(Window.unboundedPreceding, -1)
    return sessions.withColumn("busy_until", F.max(end).over(earlier)).where(F.col("busy_until") > F.col(start))


def gate(name: str, metric: Column, limit: float, at_most: bool = True) -> Column:
    """One row of a pass/fail report as a struct."""
    ok = metric <= limit if at_most else metric >= limit
    return F.struct(F.lit(name).alias("gate"), F.round(metric.cast("double"), 6).alias("value"), F.lit(float(limit)).alias("limit"), F.when(ok, "pass").otherwise("fail").alias("verdict"))


def precision_recall(scored: DataFrame, label: str, score: str, spans: int = 1024) -> DataFrame:
    """Cumulative hits and shown at each distinct score, best first, and all positives.

    Sums over score groups, then over spans of scores: only the spans, ``spans`` for each unit of the score, meet in one place.
    """
    at = scored.groupBy(score).agg(F.sum(label).alias("_p"), F.count("*").alias("_n")).withColumn("_span", F.floor(F.col(score) * spans))
    per = at.groupBy("_span").agg(F.sum("_p").alias("_sp"), F.sum("_n").alias("_sn"))
    above = Window.partitionBy(F.lit(0)).orderBy(F.desc("_span")).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(above), F.lit(0))
    base = per.select("_span", before("_sp").alias("_bp"), before("_sn").alias("_bn"), F.sum("_sp").over(Window.partitionBy(F.lit(0))).alias("_all"))
    w = Window.partitionBy("_span").orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    own = at.select(score, "_span", F.sum("_p").over(w).alias("_p"), F.sum("_n").over(w).alias("_n")).join(base, "_span")
    return own.select(score, (F.col("_bp") + F.col("_p")).cast("long").alias("hits"), (F.col("_bn") + F.col("_n")).cast("long").alias("shown"), F.col("_all").cast("long").alias("positives"))


def average_precision(scored: DataFrame, truths: DataFrame, cls: str, hit: str, score: str) -> DataFrame:
    """``(cls, shown, hits, positives, ap)``: the area below each class's precision at its recall, precision being the best at that recall or more.

    truths: cls, positives. Hits are summed by class and score before any window, so give scores rounded to the steps that
    matter. A class with nothing shown has 0.
    """
    at = scored.groupBy(cls, score).agg(F.sum(hit).alias("_p"), F.count("*").alias("_n"))
    down = Window.partitionBy(cls).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    below = Window.partitionBy(cls).orderBy(score).rowsBetween(Window.unboundedPreceding, 0)
    run = at.withColumn("_exact", F.sum("_p").over(down) / F.sum("_n").over(down)).withColumn("_best", F.max("_exact").over(below))
    per = run.groupBy(cls).agg(F.sum("_n").alias("shown"), F.sum("_p").alias("hits"), F.sum(F.col("_p") * F.col("_best")).alias("_area"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return truths.join(per, cls, "left").select(cls, zero("shown"), zero("hits"), "positives", F.coalesce(F.col("_area") / F.col("positives"), F.lit(0.0)).alias("ap"))


def regrouped(items: DataFrame, merges: DataFrame, splits: DataFrame) -> DataFrame:
    """``(item, grp)`` after merges of groups and splits of items: merged groups take the smallest id, a split item has no group but its own (null).

    items: item, grp; merges: a, b; splits: item, repeats allowed. Taking a row out of merges or splits undoes it.
    """
    roots = connected_components(merges, "a", "b")
    own = items.join(splits.select("item", F.lit(True).alias("_alone")).distinct(), "item", "left").join(roots.withColumnRenamed("node", "grp"), "grp", "left")
    return own.select("item", F.when(F.col("_alone").isNull(), F.coalesce("component", "grp")).alias("grp"))


def op_tree_histogram(edges: DataFrame, root: str) -> DataFrame:
    """Counts of node types below a root of an adjacency table (parent, child, kind): a recursive expression for shallow trees."""
    return edges.sparkSession.sql("""WITH RECURSIVE tree (node, kind, depth) AS (
      SELECT child, kind, 1 FROM {edges} WHERE parent = {root}
      UNION ALL SELECT e.child, e.kind, t.depth + 1 FROM tree t JOIN {edges} e ON e.parent = t.node)
    SELECT kind, CAST(depth AS BIGINT) AS depth, count(*) AS n FROM tree GROUP BY kind, depth""", edges=edges, root=root)


EXAMPLE = "group_id long, code long, v array<float>, session long"


def teach(confirmed: DataFrame, path: str) -> None:
    """Appends confirmed groups (group_id, code, v, session) as examples, a folder for each session; nothing written is changed."""
    confirmed.select("group_id", F.col("code").cast("long").alias("code"), F.col("v").cast("array<float>").alias("v"), F.col("session").cast("long").alias("session")).repartition("session").write.mode("append").partitionBy("session").parquet(path)


def examples(spark: SparkSession, path: str) -> DataFrame:
    """All examples taught so far; a filter on ``session`` reads only the folders it needs."""
    return spark.read.schema(EXAMPLE).parquet(path)
