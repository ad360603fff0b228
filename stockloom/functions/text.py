"""String functions of the catalogue and the export."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent_error(a: Column, b: Column) -> Column:
    """Signed whole percent of ``a`` against ``b``; ``n/a`` if ``b`` is 0."""
    return F.when(b == 0, "n/a").otherwise(F.format_string("%+.0f%%", F.rint(100.0 * (a - b) / b)))


def escape_cell(c: Column) -> Column:
    """A spreadsheet cell that is not read as a formula: an apostrophe before ``= + - @``."""
    return F.when(c.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)


def gtin_check_digit(body: Column) -> Column:
    """The GS1 check digit of the digits before it: weights 3 and 1 from the right."""
    digits = F.transform(F.split(F.reverse(body), ""), lambda d: d.cast("int"))
    total = F.aggregate(F.transform(digits, lambda d, i: F.coalesce(d, F.lit(0)) * F.when(i % 2 == 0, 3).otherwise(1)), F.lit(0), lambda a, d: a + d)
    return (10 - total % 10) % 10


def gtin14(body: Column) -> Column:
    padded = F.lpad(body, 13, "0")
    return F.concat(padded, gtin_check_digit(padded).cast("string"))


def known_classes(table: Column, classes: tuple[str, ...]) -> Column:
    """The map as it is; an error that names a key which is none of ``classes``."""
    odd = F.filter(F.map_keys(table), lambda k: ~k.isin(*classes))
    return F.when(F.size(odd) > 0, F.raise_error(F.concat(F.lit("unknown class: "), F.array_join(odd, ", ")))).otherwise(table)


def literal_table(text: Column) -> Column:
    """``a=1,b=2`` as a map of trimmed keys to whole numbers; a repeated key is an error."""
    pairs = F.transform(F.split(text, ","), lambda p: F.struct(F.trim(F.element_at(F.split(p, "="), 1)).alias("k"), F.trim(F.element_at(F.split(p, "="), 2)).cast("long").alias("v")))
    return F.map_from_entries(pairs)
