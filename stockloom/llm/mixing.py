"""Mixing sources to target weights by weighted sampling without replacement (Efraimidis and Spirakis, 2006).

Each document draws an exponential key divided by its quality weight. Within a source documents are taken in key order
until their summed sizes reach the source's budget; whole epochs come first, the draw decides the remaining fraction.
The prefix sum has three levels: sums of key cells find the cell where a source's budget ends, the distinct keys of that cell
are sorted, and rows with the key at the end, which are repeated rows, are counted by the partition they were written in. So no
task holds a whole source. Cells are steps of the logarithm of the key: an exponential key of any weight falls in one of them with
a probability of at most ``ln(2) / (e * CELLS)``. Expressions and joins only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockloom.llm.text import WORD
from stockloom.plans.durable import staged

CELLS = 512  # for each doubling of the key


def word_count(text_col: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text_col: str, size: Column) -> Column:
    """1 for a text without marks of mark-up or tables, down to 0.05 for one such mark a word."""
    marks = F.length(text_col) - F.length(F.translate(text_col, "#*$%&|<>", ""))
    return F.coalesce(F.greatest(F.lit(0.05), 1 - marks / F.greatest(size, F.lit(1))), F.lit(1.0))


def targets(sources: DataFrame, weights: tuple[float, ...], max_epochs: float, share: float) -> DataFrame:
    """Adds ``target`` to ``(source, source_size)``, one row for each source.

    ``share`` of all sizes is shared by weight; a target stops at ``max_epochs`` times its source's size and the excess is
    shared again by weight. That is a water level: sorted by cap over weight, the first source that stays under its cap
    shows the level for all after it. Windows run over a row for each source.
    """
    everything = Window.partitionBy(F.lit(0))
    by_name = everything.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    weighed = sources.withColumn("_w", F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))).withColumn("_cap", max_epochs * F.col("source_size"))
    by_ratio = everything.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    earlier = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    filled = F.coalesce(F.sum("_cap").over(earlier), F.lit(0.0))
    open_weight = F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(earlier), F.lit(0.0))
    level = (share * F.sum("source_size").over(everything) - filled) / open_weight
    first = F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.struct("_n", "_level"))
    ranked = weighed.withColumn("_level", level).withColumn("_n", F.row_number().over(by_ratio))
    leveled = ranked.withColumn("_found", F.min(first).over(everything))
    target = F.least(F.col("_cap"), F.coalesce(F.col("_found._level") * F.col("_w"), F.col("_cap")))
    return leveled.select("source", "source_size", target.alias("target"))


def _drawn(docs: DataFrame, id_col: str, text_col: str, source_col: str, weight: Column | None, seed: int) -> DataFrame:
    """``docs`` with ``_size``, ``_source``, ``_key``, ``_cell`` and ``_n``; a tie in all of the key is a repeated row.

    ``_n`` numbers rows by partition and place: write the table before using it, so that the numbers stay.
    """
    sized = docs.withColumn("_size", word_count(text_col)).withColumn("_source", F.col(source_col).cast("string"))
    w = quality_weight(text_col, F.col("_size")) if weight is None else F.greatest(F.coalesce(weight.cast("double"), F.lit(1.0)), F.lit(1e-6))
    code = F.coalesce(F.crc32(F.col(text_col).cast("binary")), F.lit(-1))
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), id_col, code), 11) + 0.5) / float(2**53)
    drawn = sized.withColumn("_key", F.struct((-F.log(u) / w).alias("draw"), F.col(id_col).cast("long").alias("id"), code.alias("code"), F.col("_size").alias("size")))
    return drawn.withColumn("_cell", F.floor(CELLS * F.log2("_key.draw")).cast("int")).withColumn("_n", F.monotonically_increasing_id())


def _last_copy(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """``(source, cut_n)`` where only ``copies`` of the rows with a source's last key are taken: the ``_n`` of the last of them.

    Such rows are counted by the partition they were written in; only one partition's rows are sorted for each source.
    """
    some = cuts.where("copies < there").select(F.col("source").alias("_s"), "cut_cell", "cut_key", "copies")
    same = F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_cell") == F.col("cut_cell")) & (F.col("_key") == F.col("cut_key"))
    tied = rows.join(some, same).select("_s", "_n", F.shiftrightunsigned("_n", 33).alias("_part"), "copies")
    parts = tied.groupBy("_s", "_part", "copies").agg(F.count("*").alias("_m"))
    parts = parts.withColumn("_to", F.sum("_m").over(Window.partitionBy("_s").orderBy("_part"))).where(F.col("_to") >= F.col("copies"))
    end = parts.groupBy("_s").agg(F.min(F.struct("_part", (F.col("copies") - F.col("_to") + F.col("_m")).alias("nth"))).alias("e"))
    end = end.select(F.col("_s").alias("_t"), F.col("e._part").alias("_own"), "e.nth")
    ranked = tied.join(end, F.col("_s").eqNullSafe(F.col("_t")) & (F.col("_part") == F.col("_own"))).withColumn("_r", F.row_number().over(Window.partitionBy("_s").orderBy("_n")))
    return ranked.where("_r = nth").select(F.col("_s").alias("_u"), F.col("_n").alias("cut_n"))


def plan_mix(rows: DataFrame, weights: tuple[float, ...], max_epochs: float, share: float) -> DataFrame:
    """For each source of the written ``rows`` its size, target, whole epochs, and where its draw ends: cell, key and row."""
    cells = rows.groupBy("_source", "_cell").agg(F.sum("_size").alias("_sum"))
    sources = staged(targets(cells.groupBy(F.col("_source").alias("source")).agg(F.sum("_sum").alias("source_size")), weights, max_epochs, share), "targets")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    sources = sources.withColumn("epochs", epochs).withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size"))
    reach = F.sum("_sum").over(Window.partitionBy("_source").orderBy("_cell"))
    ends = cells.withColumn("_reach", reach).join(sources, F.col("_source").eqNullSafe(F.col("source"))).where(F.col("_reach") > F.col("budget"))
    end = ends.groupBy("source").agg(F.min_by(F.struct("_cell", (F.col("budget") - F.col("_reach") + F.col("_sum")).alias("rest")), "_cell").alias("e")).select(F.col("source").alias("_s"), F.col("e._cell").alias("cut_cell"), "e.rest")
    end = staged(end, "ends")
    last = rows.where("_size > 0").join(end, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_cell") == F.col("cut_cell")))
    keys = last.groupBy("_s", "cut_cell", "_key", "rest").agg(F.count("*").alias("there"))
    size = F.col("_key.size")
    before = F.sum(size * F.col("there")).over(Window.partitionBy("_s").orderBy("_key")) - size * F.col("there")
    take = F.least(F.col("there"), F.floor((F.col("rest") - before) / size + 0.5))  # the last one where that comes nearer to the target
    cut = keys.withColumn("copies", take.cast("long")).where("copies > 0").groupBy("_s", "cut_cell").agg(F.max(F.struct(F.col("_key").alias("cut_key"), "copies", "there")).alias("c"))
    cut = staged(cut.select(F.col("_s").alias("source"), "cut_cell", "c.cut_key", "c.copies", "c.there"), "cuts")
    out = sources.join(end.select("_s", "cut_cell"), F.col("source").eqNullSafe(F.col("_s")), "left")
    out = out.join(cut.select(F.col("source").alias("_t"), "cut_key"), F.col("source").eqNullSafe(F.col("_t")), "left")
    out = out.join(_last_copy(rows, cut), F.col("source").eqNullSafe(F.col("_u")), "left")
    return staged(out.select("source", "source_size", "target", "epochs", "cut_cell", "cut_key", "cut_n"), "mix")


def _copies() -> Column:
    """How often the mix takes a document: the whole epochs, and once more before the end of its source's draw.

    A document without words adds nothing to a budget: it is taken once an epoch, and once where there is no whole epoch.
    """
    tied = (F.col("_key") == F.col("cut_key")) & (F.col("cut_n").isNull() | (F.col("_n") <= F.col("cut_n")))
    before = F.col("cut_cell").isNull() | (F.col("_cell") < F.col("cut_cell")) | ((F.col("_cell") == F.col("cut_cell")) & F.coalesce((F.col("_key") < F.col("cut_key")) | tied, F.lit(False)))
    more = F.when(F.col("_size") > 0, before).otherwise(F.col("epochs") == 0)
    return (F.col("epochs") + more.cast("long")).cast("long")


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), max_epochs: float = 3.0, share: float = 1.0,
    weight: Column | None = None, seed: int = 17,
) -> DataFrame:
    """``(id, size, source, source_size, target, taken, copies)`` for each row of ``docs``.

    Sources in code-point order, null last, weigh ``weights`` in turn. ``weight`` is a document's quality weight; by default
    it comes from its text. The document at the end of a draw is taken if that comes nearer to the target, so that a source
    misses its target by half of one document at most, repeated rows included: of equal rows as many are taken as fit. Null
    texts have size 0; sources without words have target 0. Equal seeds and rows give equal results. An empty table gives none.
    """
    drawn = _drawn(docs, id_col, text_col, source_col, weight, seed)
    rows = staged(drawn.select(F.col(id_col).alias("_id"), "_size", "_source", "_cell", "_key", "_n"), "drawn")
    got = rows.join(plan_mix(rows, weights, max_epochs, share), F.col("_source").eqNullSafe(F.col("source")))
    return got.select(F.col("_id").alias(id_col), F.col("_size").alias("size"), "source", "source_size", "target", (F.col("_size") * _copies()).alias("taken"), _copies().alias("copies"))


def mixed_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), max_epochs: float = 3.0, share: float = 1.0,
    weight: Column | None = None, seed: int = 17,
) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; the same for nulls, ties and empty tables as ``mix``.

    Rows are written once with their keys, so that words are counted once and repeated rows keep their numbers; texts are not shuffled.
    """
    whole = docs.withColumns({"_weight": F.lit(1.0) if weight is None else weight, "_row": F.struct(*(F.col(f"`{c}`") for c in docs.columns))})
    slim = whole.select("_row", F.col(f"_row.`{id_col}`").alias("_id"), F.col(f"_row.`{text_col}`").alias("_text"), F.col(f"_row.`{source_col}`").alias("_from"), "_weight")  # no other names can clash
    rows = staged(_drawn(slim, "_id", "_text", "_from", None if weight is None else F.col("_weight"), seed).select("_row", "_size", "_source", "_cell", "_key", "_n"), "drawn")
    sources = plan_mix(rows, weights, max_epochs, share)
    got = rows.join(sources, F.col("_source").eqNullSafe(F.col("source"))).withColumn("_copies", _copies())
    once = got.where("_copies > 0").withColumn("_nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    return once.select("_row.*")
