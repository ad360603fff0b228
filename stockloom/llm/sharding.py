"""A uniform random deal of rows to shards of exact sizes, by a communication matrix.

Row counts of the source partitions are fixed; how many rows each of them sends to each shard is drawn from the
multivariate hypergeometric law, which is what a uniform permutation of all rows would give. Each partition then permutes
its rows and sends the drawn numbers, and each shard permutes what it has received. The matrix is drawn at two levels:
groups of partitions in one row, then the partitions of each group in a row of its own. A draw costs the same at every row
count. Expressions, joins and windows only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockloom.plans.durable import staged

MOST_PARTS, GROUP = 4096, 64
SLOT_BITS = 10
SUMMED = 400.0  # variance up to which terms are summed
TRIES = 64


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _log_factorial_step(a: Column, b: Column) -> Column:
    """``ln(b!) - ln(a!)`` by Stirling's series, without the cancellation of two large numbers.

    Rejection is used where all counts at the mode are in the hundreds, so that the series is exact there; far below, where
    it is off by 3e-4 at most, the odds are under e^-50.
    """

    def step(q: Column) -> Column:
        x, y = q["x"], q["y"]
        return (x - 0.5) * F.log1p((y - x) / x) + (y - x) * (F.log(y) - 1) + (1 / y - 1 / x) / 12 - (1 / (y * y * y) - 1 / (x * x * x)) / 360

    return _bound(F.struct((a + 1).alias("x"), (b + 1).alias("y")), step)


def _by_sum(p: Column, seed: list[Column]) -> Column:
    """Inversion: terms of the law are summed outwards from the mode, by their ratios, over 9 standard deviations (mass beyond: 1e-18)."""

    def steps(count: Column) -> Column:
        return F.when(count > 0, F.sequence(F.lit(1), F.greatest(count, F.lit(1)))).otherwise(F.expr("cast(array() as array<int>)"))

    def rise(q: Column, i: Column) -> Column:
        x = q["m"] + i - 1
        return (q["k"] - x) * (q["d"] - x) / ((x + 1) * (q["n"] - q["k"] - q["d"] + x + 1))

    def fall(q: Column, i: Column) -> Column:
        x = q["m"] - i + 1
        return x * (q["n"] - q["k"] - q["d"] + x) / ((q["k"] - x + 1) * (q["d"] - x + 1))

    def total(q: Column, ratio, count: Column) -> Column:
        zero = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("t"))
        return F.aggregate(steps(count), zero, lambda s, i: F.struct((s["w"] * ratio(q, i)).alias("w"), (s["t"] + s["w"] * ratio(q, i)).alias("t")), lambda s: s["t"])

    def find(q: Column, ratio, count: Column, want: Column) -> Column:
        zero = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("t"), F.lit(0).alias("at"))
        step = lambda s, i: F.struct((s["w"] * ratio(q, i)).alias("w"), (s["t"] + s["w"] * ratio(q, i)).alias("t"), F.when(s["t"] < want, i).otherwise(s["at"]).alias("at"))
        return F.aggregate(steps(count), zero, step, lambda s: s["at"])

    reach = F.ceil(9 * F.sqrt(p["v"])) + 20
    up, down = (F.least(room, reach.cast("double")).cast("int") for room in (p["high"] - p["m"], p["m"] - p["low"]))

    def draw(r: Column) -> Column:
        want = r["u"] * (1 + r["a"] + r["b"])
        above, below = find(p, rise, up, want - 1), find(p, fall, down, want - 1 - r["a"])
        return F.when(want < 1, p["m"]).when(want < 1 + r["a"], p["m"] + above).otherwise(p["m"] - below)

    return _bound(F.struct(total(p, rise, up).alias("a"), total(p, fall, down).alias("b"), uniform(*seed).alias("u")), draw)


def _by_rejection(p: Column, seed: list[Column]) -> Column:
    """Ratio of uniforms (Stadlober, 1990) on the smaller of good and bad and of drawn and left, then back by symmetry.

    About three in four tries are taken; after ``TRIES`` refusals (1e-38) the mode is.
    """
    mean = p["d"] * p["k"] / p["n"]
    hat = 1.7155277699214135 * F.sqrt(p["v"] + 0.5) + 0.8989161620588988  # 2 sqrt(2 / e) and 3 - 2 sqrt(3 / e)

    def attempt(i: Column) -> Column:
        u, w = uniform(*seed, F.lit("u"), i), uniform(*seed, F.lit("v"), i)

        def judge(x: Column) -> Column:
            rest = p["n"] - p["k"] - p["d"]
            odds = _log_factorial_step(x, p["m"]) + _log_factorial_step(p["k"] - x, p["k"] - p["m"]) + _log_factorial_step(p["d"] - x, p["d"] - p["m"]) + _log_factorial_step(rest + x, rest + p["m"])
            inside = (x >= p["low"]) & (x <= p["high"])
            return F.when(inside, F.when(2 * F.log(u) <= odds, x))

        return _bound(F.floor(mean + 0.5 + hat * (w - 0.5) / u).cast("double"), judge)

    first = F.aggregate(F.sequence(F.lit(1), F.lit(TRIES)), F.lit(None).cast("double"), lambda got, i: F.when(got.isNotNull(), got).otherwise(attempt(i)))
    return F.coalesce(first, p["m"])


def hypergeometric(whole: Column, good: Column, draws: Column, seed: list[Column]) -> Column:
    """The number of good ones in ``draws`` from ``whole`` with ``good``, drawn by the hash of ``seed``.

    Small variances are inverted, others drawn by rejection: both follow the law itself, and neither grows with the counts.
    """
    n, k, d = (c.cast("double") for c in (whole, good, draws))
    few, drawn = k <= n - k, d <= n - d
    p = F.struct(n.alias("n"), F.when(few, k).otherwise(n - k).alias("k"), F.when(drawn, d).otherwise(n - d).alias("d"), few.alias("few"), drawn.alias("drawn"), k.alias("good"), d.alias("draws"))

    def shape(q: Column) -> Column:
        safe = F.greatest(q["n"], F.lit(1.0))
        var = q["d"] * q["k"] / safe * (1 - q["k"] / safe) * (q["n"] - q["d"]) / F.greatest(q["n"] - 1, F.lit(1.0))
        high = F.least(q["d"], q["k"])
        mode = F.least(high, F.floor((q["d"] + 1) * (q["k"] + 1) / (q["n"] + 2)).cast("double"))
        return F.struct(*(q[c].alias(c) for c in ("n", "k", "d", "few", "drawn", "good", "draws")), F.greatest(F.lit(0.0), var).alias("v"), F.lit(0.0).alias("low"), high.alias("high"), mode.alias("m"))

    def back(q: Column, x: Column) -> Column:
        """From the smaller kinds to what was asked: first of the kinds, then of the draws."""
        own = _bound(x, lambda y: F.when(q["few"], y).otherwise(q["d"] - y))
        return _bound(own, lambda y: F.when(q["drawn"], y).otherwise(q["good"] - y)).cast("long")

    value = lambda q: F.when(q["v"] <= SUMMED, _by_sum(q, seed)).otherwise(_by_rejection(q, seed))
    return _bound(p, lambda q: _bound(shape(q), lambda s: back(s, value(s))))


def uniform(*cols: Column) -> Column:
    return (F.shiftrightunsigned(F.xxhash64(*cols), 11) + 0.5) / float(2**53)


def deal(parts: Column, capacity: Column, seed: int, name: Column) -> Column:
    """Rows ``(id, sent)`` of a matrix with row sums ``parts`` (array of struct(id, n)) and column sums ``capacity``."""
    nothing = F.expr("cast(array() as array<bigint>)")

    def row(left: Column, part: Column) -> Column:
        """What one part sends: shard by shard, from what the shards still lack."""
        lack = F.aggregate(left, F.lit(0).cast("long"), lambda a, x: a + x)
        zero = F.struct(lack.alias("whole"), part["n"].cast("long").alias("rest"), nothing.alias("sent"))

        def shard(s: Column, j: Column) -> Column:
            room = F.element_at(left, j)
            x = hypergeometric(s["whole"], room, s["rest"], [F.lit(seed), name, part["id"], j])
            once = F.transform(F.array(x), lambda y: F.struct((s["whole"] - room).alias("whole"), (s["rest"] - y).alias("rest"), F.concat(s["sent"], F.array(y)).alias("sent")))
            return F.element_at(once, 1)

        return F.aggregate(F.sequence(F.lit(1), F.size(left)), zero, shard, lambda s: s["sent"])

    zero = F.struct(capacity.alias("left"), F.expr("cast(array() as array<struct<id:bigint,sent:array<bigint>>>)").alias("rows"))

    def step(s: Column, part: Column) -> Column:
        def use(sent: Column) -> Column:
            return F.struct(F.zip_with(s["left"], sent, lambda a, b: a - b).alias("left"), F.concat(s["rows"], F.array(F.struct(part["id"].cast("long").alias("id"), sent.alias("sent")))).alias("rows"))

        return F.element_at(F.transform(F.array(row(s["left"], part)), use), 1)

    return F.aggregate(parts, zero, step, lambda s: s["rows"])


def communication_matrix(parts: DataFrame, shards: int, seed: int) -> DataFrame:
    """``(part, sent)`` from ``(part, n)``: the rows that each partition sends to each shard; shard sizes differ by one at most.

    Partitions are drawn in ``GROUP`` groups: first what each group sends, in one row, then each group's partitions in a row of
    its own. A draw costs the same at every row count, so that the first row is a fraction of a second's work.
    """
    grouped = parts.groupBy((F.col("part") % GROUP).cast("long").alias("g")).agg(F.sort_array(F.collect_list(F.struct(F.col("part").cast("long").alias("id"), F.col("n").alias("n")))).alias("parts"), F.sum("n").alias("n"))
    top = grouped.agg(F.sort_array(F.collect_list(F.struct(F.col("g").alias("id"), "n"))).alias("parts"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    capacity = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda j: F.floor(F.col("n") / shards) + (j < F.col("n") % shards).cast("long"))
    rows = F.explode(deal(F.col("parts"), F.col("lot"), seed, F.col("level"))).alias("r")  # built once: it is a large expression
    lots = staged(top.select("parts", capacity.alias("lot"), F.lit("groups").alias("level")).select(rows).select(F.col("r.id").alias("g"), F.col("r.sent").alias("lot")), "lots")
    return staged(grouped.join(lots, "g").select("parts", "lot", F.lit("parts").alias("level")).select(rows).select(F.col("r.id").alias("part"), "r.sent"), "matrix")


def shuffle_shards(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", seed: int = 23, overhead: int = 16, parts: int = MOST_PARTS) -> DataFrame:
    """``(id, size, text_crc32, shard, slot)`` for each row: a uniform random deal, shard counts at most one apart.

    size: UTF-8 bytes of the text (null: none) and ``overhead``; the crc of a null text is that of an empty one. Slots
    count from 0 in each shard. Source partitions are those of the scan, so that a deal is repeated with equal
    input splits and seed; repeated rows are dealt like others. An empty table gives no rows. The matrix has ``parts`` rows at
    most: beyond so many partitions several are permuted together (about 40 bytes a row, no texts).
    """
    slim = staged(
        docs.select(
            F.col(id_col).cast("long").alias("_id"), (F.coalesce(F.octet_length(text_col), F.lit(0)) + overhead).cast("long").alias("size"),
            F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"), (F.spark_partition_id() % parts).cast("long").alias("part"),
        ), "slim",
    )
    matrix = communication_matrix(slim.groupBy("part").agg(F.count("*").alias("n")), shards, seed)
    upto = F.transform(F.sequence(F.lit(1), F.size("sent")), lambda j: F.aggregate(F.slice("sent", F.lit(1), j), F.lit(0).cast("long"), lambda a, x: a + x))
    first = Window.partitionBy("part").orderBy(F.xxhash64(F.lit(seed), "part", "_id", "text_crc32"), "_id", "text_crc32", "size")
    ranked = slim.withColumn("_r", F.row_number().over(first)).join(matrix.select("part", upto.alias("_upto")), "part")
    key = F.xxhash64(F.lit(seed + 1), "part", "_id", "text_crc32", "_r")
    sent = ranked.select("_id", "size", "text_crc32", F.size(F.filter("_upto", lambda c: c < F.col("_r"))).alias("shard"), key.alias("_key"))
    dealt = staged(sent.withColumn("_cell", F.shiftrightunsigned("_key", 64 - SLOT_BITS).cast("int")), "dealt")
    cells = dealt.groupBy("shard", "_cell").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select("shard", "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    second = Window.partitionBy("shard", "_cell").orderBy("_key", "_id", "text_crc32", "size")
    placed = dealt.withColumn("_nth", F.row_number().over(second)).join(starts, ["shard", "_cell"])
    return placed.select(F.col("_id").alias(id_col), "size", "text_crc32", "shard", (F.col("_before") + F.col("_nth") - 1).cast("long").alias("slot"))
