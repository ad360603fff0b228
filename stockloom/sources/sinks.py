"""Writers: stock sheets as CSV and XLSX, COCO and summary documents, Markdown tables.

Sheets and reports are small by nature (a line for each product of a venue); everything else is written by Spark.
"""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockloom.functions.text import escape_cell

EXPORT_COLUMNS = "session_id venue zone counted_at counted_by sku_code sku_name brand category size_ml units_per_case full_cases loose_units total_units source notes".split()
NUMBERS = frozenset("size_ml units_per_case full_cases loose_units total_units".split())


def export_lines(lines: DataFrame) -> DataFrame:
    """The fixed columns as text, with cells that look like formulas escaped; absent columns are empty."""
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in lines.columns else F.lit("")
    return lines.select(*((cell(c) if c in NUMBERS else escape_cell(cell(c))).alias(c) for c in EXPORT_COLUMNS))


def csv_lines(lines: DataFrame, sep: str = ";", mark: bool = True) -> DataFrame:
    """A column ``value`` of CSV lines with a header first; ``mark`` puts a byte-order mark before it, as spreadsheets expect."""
    table = export_lines(lines)
    quoted = lambda c: F.when(F.col(c).rlike(rf'["\r\n{sep}]'), F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.col(c))
    body = table.select(F.lit(1).alias("_o"), F.concat_ws(sep, *(quoted(c) for c in EXPORT_COLUMNS)).alias("value"))
    head = lines.sparkSession.range(1).select(F.lit(0).alias("_o"), F.lit(("﻿" if mark else "") + sep.join(EXPORT_COLUMNS)).alias("value"))
    return head.unionByName(body).orderBy("_o", "value").select("value")


def write_csv(lines: DataFrame, path: str, sep: str = ";", mark: bool = True) -> None:
    csv_lines(lines, sep, mark).coalesce(1).write.mode("overwrite").option("lineSep", "\r\n").text(path)


def _column(i: int) -> str:
    return chr(65 + i) if i < 26 else _column(i // 26 - 1) + _column(i % 26)


def xlsx_bytes(lines: DataFrame, max_rows: int = 1_000_000) -> bytes:
    """One worksheet of a stock sheet as an OOXML file. A sheet has a bound of its own, so more rows are an error."""
    rows = export_lines(lines).orderBy("zone", "sku_code").limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"a worksheet holds at most {max_rows} lines")

    def cell(r: int, i: int, name: str, v: str) -> str:
        ref = f"{_column(i)}{r}"
        if name in NUMBERS and r > 1 and v:
            return f'<c r="{ref}"><v>{v}</v></c>'
        return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>'

    table = [EXPORT_COLUMNS, *([row[c] for c in EXPORT_COLUMNS] for row in rows)]
    body = "".join(f'<row r="{r}">' + "".join(cell(r, i, n, v) for i, (n, v) in enumerate(zip(EXPORT_COLUMNS, row, strict=True))) + "</row>" for r, row in enumerate(table, 1))
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    pack = "http://schemas.openxmlformats.org/package/2006"
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{pack}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{pack}/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="Stock" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{pack}/relationships"><Relationship Id="r1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n' + text)
    return out.getvalue()


def coco_document(images: DataFrame, annotations: DataFrame, categories: DataFrame) -> DataFrame:
    """One row ``value``: the three lists of a COCO document of one walk as JSON."""
    one = lambda df, name: df.agg(F.sort_array(F.collect_list(F.struct(*df.columns))).alias(name))
    return one(images, "images").crossJoin(one(annotations, "annotations")).crossJoin(one(categories, "categories")).select(F.to_json(F.struct("images", "annotations", "categories")).alias("value"))


def summary_json(settings: dict[str, str], commits: DataFrame, totals: DataFrame) -> DataFrame:
    """One row ``value``: settings, commits in order, and totals as a map of detector to class counts. totals: detector, cls, n."""
    per = totals.groupBy("detector").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("cls", "n")))).alias("m"))
    counts = per.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("detector", F.to_json("m").alias("m"))))).alias("totals"))
    listed = commits.agg(F.sort_array(F.collect_list(F.struct(*commits.columns))).alias("commits"))
    known = F.create_map(*(x for k, v in settings.items() for x in (F.lit(k), F.lit(v)))) if settings else F.expr("map()")
    return listed.crossJoin(counts).select(F.to_json(F.struct(known.alias("settings"), "commits", "totals")).alias("value"))


def truth_document(objects: DataFrame, affines: DataFrame, holds: DataFrame, pause: tuple[float, float], frame_size: tuple[int, int], fps: int, px_per_m: float) -> DataFrame:
    """One row ``value``: the truth of one walk as JSON, with its objects, a transform for each frame, and its holds in order.

    objects: id, cls, sku, box; affines: frame, m; holds: t_from, t_to. A walk's document is one row by its nature.
    """
    listed = objects.agg(F.sort_array(F.collect_list(F.struct("id", "cls", "sku", "box"))).alias("objects"))
    moved = affines.agg(F.transform(F.sort_array(F.collect_list(F.struct("frame", "m"))), lambda s: s["m"]).alias("affine"))
    held = holds.agg(F.transform(F.sort_array(F.collect_list(F.struct("t_from", "t_to"))), lambda s: F.array(s["t_from"], s["t_to"])).alias("holds"))
    known = F.array(*map(F.lit, pause)).alias("pause"), F.array(*map(F.lit, frame_size)).alias("frame_size"), F.lit(fps).alias("fps"), F.lit(px_per_m).alias("px_per_m")
    return moved.crossJoin(held).crossJoin(listed).select(F.to_json(F.struct("affine", "holds", *known, "objects")).alias("value"))


def inventory_json(histogram: DataFrame) -> DataFrame:
    """One row ``value``: the counts of node kinds as a JSON object with sorted keys. histogram: kind, n."""
    per = histogram.groupBy("kind").agg(F.sum("n").alias("n"))
    return per.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n"))))).alias("value"))


def markdown_table(df: DataFrame, max_rows: int = 1000) -> str:
    """A report table. A report is read by people, so that more than ``max_rows`` rows are an error."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"a report holds at most {max_rows} rows")
    line = lambda cells: "| " + " | ".join("–" if c is None else f"{c:g}" if isinstance(c, float) else str(c) for c in cells) + " |"
    return "\n".join([line(df.columns), "|" + "---|" * len(df.columns), *map(line, rows)]) + "\n"
