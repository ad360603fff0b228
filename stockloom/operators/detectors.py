"""Detectors by name: what a detector shows and counts is a pair of thresholds; tiled ones also lose boxes at an inner tile edge."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udtf, udtf
from pyspark.sql.types import BooleanType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

# The scores from which a detector shows and counts a box, and whether it works on tiles.
THRESHOLDS = {"rfdetr": (0.3, 0.5, False), "rfdetr_tiled": (0.3, 0.5, True), "owlv2": (0.2, 0.3, False), "owlv2_caps": (0.15, 0.2, False), "oracle": (0.5, 0.5, False)}
TILE, EDGE = (64.0, 48.0), 2.0


def names() -> list[str]:
    return list(THRESHOLDS)


def at_tile_edge(edge_x: float, edge_y: float, margin: float = EDGE) -> Column:
    """Whether a box ends within ``margin`` of an inner tile edge, where another tile sees the whole of it."""
    return F.least(*(F.abs(F.col(c) - e) for c, e in (("x0", edge_x), ("x1", edge_x), ("y0", edge_y), ("y1", edge_y)))) <= margin


def detector(name: str) -> Callable[[DataFrame], DataFrame]:
    """The detector of that name as a function on scored boxes: the boxes that it shows, with ``counted``. Unknown names are an error."""
    if name not in THRESHOLDS:
        raise ValueError(f"no detector {name!r}; there are {', '.join(THRESHOLDS)}")
    shown, counted, tiled = THRESHOLDS[name]

    def apply(boxes: DataFrame) -> DataFrame:
        whole = boxes.where(~at_tile_edge(*TILE)) if tiled else boxes
        return whole.where(F.col("score") >= shown).withColumn("counted", F.col("score") >= counted)

    return apply


class _Detector:
    """The table function: boxes in, the boxes that the named detector shows out, with ``counted``."""

    @staticmethod
    def analyze(boxes: AnalyzeArgument, name: AnalyzeArgument) -> AnalyzeResult:
        if name.value not in THRESHOLDS:
            raise ValueError(f"no detector {name.value!r}; there are {', '.join(THRESHOLDS)}")
        return AnalyzeResult(StructType([*boxes.dataType.fields, StructField("counted", BooleanType())]))

    def eval(self, box, name: str):
        shown, counted, tiled = THRESHOLDS[name]
        cut = tiled and min(abs(box["x0"] - TILE[0]), abs(box["x1"] - TILE[0]), abs(box["y0"] - TILE[1]), abs(box["y1"] - TILE[1])) <= EDGE
        if box["score"] is not None and box["score"] >= shown and not cut:
            yield (*box, box["score"] >= counted)


class _BatchDetector:
    """The same for boxes of one schema, an Arrow batch at a time. An unknown name is an error as well, once there are boxes."""

    def eval(self, boxes: pa.RecordBatch, name: pa.Array) -> Iterator[pa.Table]:
        for n in pc.unique(name).to_pylist():
            if n not in THRESHOLDS:
                raise ValueError(f"no detector {n!r}; there are {', '.join(THRESHOLDS)}")
            shown, counted, tiled = THRESHOLDS[n]
            own = pa.Table.from_batches([boxes]).filter(pc.equal(name, n))
            keep = pc.greater_equal(own["score"], shown)
            if tiled:
                edges = (pc.abs(pc.subtract(own[c], e)) for c, e in zip(("x0", "x1", "y0", "y1"), (*TILE[:1] * 2, *TILE[1:] * 2), strict=True))
                keep = pc.and_(keep, pc.greater(pc.min_element_wise(*edges), EDGE))
            own = own.filter(keep)
            yield own.append_column("counted", pc.greater_equal(own["score"], counted))


def register(spark: SparkSession, boxes: StructType | None = None) -> None:
    """``SELECT * FROM detector(TABLE(...), 'owlv2')``: any table with x0, y0, x1, y1 and score; an unknown name is an error of the analysis.

    With the schema ``boxes`` only tables of that schema, which are then taken in batches: rows one by one cost most of the time.
    """
    spark.udtf.register("detector", udtf(_Detector) if boxes is None else arrow_udtf(_BatchDetector, returnType=StructType([*boxes.fields, StructField("counted", BooleanType())])))
