"""Records out of raw text, HTML and JSON columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.text import without_last_newline
from tidemark.operators.spread import lookup_join
from tidemark.scratch import scratch_path


def scan_lines(df: DataFrame, id: str, text: str) -> DataFrame:
    """Documents to lines: (id, pos from 0, line). A null or empty text has no lines, as for line tools."""
    lines = F.split(without_last_newline(F.nullif(F.col(text), F.lit(""))), "\n")
    return df.select(id, F.posexplode(lines).alias("pos", "line"))


def scan_file_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text files to lines: (path, pos from 0, line), as ``scan_lines`` has them, but a file of any size is read in as many
    splits as it has blocks.

    Lines get their number within a split where they are read, and are written once with it, since another reading need
    not split files at the same places. A split's first position is the number of lines in the splits before it: a row
    per split. A single line has to fit a task's memory.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"),
        F.col("value").alias("line"),
    )
    folder = scratch_path(spark, "file-lines")
    lines.write.parquet(folder)
    lines = spark.read.schema(lines.schema).parquet(folder)
    splits = lines.groupBy("path", "_block").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_lines"))
    before = Window.partitionBy("path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_start", F.coalesce(F.sum("_lines").over(before), F.lit(0))).drop("_lines")
    placed = lookup_join(lines, splits, ["path", "_block"], "inner", ["_at"])
    return placed.select("path", (F.col("_start") + F.col("_at") - F.col("_first")).alias("pos"), "line")


def scan_settings(df: DataFrame, id: str, text: str) -> DataFrame:
    """Lines ``[#] key value`` out of texts: (id, pos, setting, value, commented).

    The value is what stands up to the next blank; a line may be indented, and the sign may stand off from
    the key. All other lines are left out.
    """
    field = lambda n: F.regexp_extract("line", r"^[ \t]*(#?)[ \t]*([^ \t#]+)[ \t]+([^ \t]+)", n)
    found = scan_lines(df, id, text).select(
        id, "pos", field(2).alias("setting"), field(3).alias("value"), (field(1) == "#").alias("commented")
    )
    return found.where("setting <> ''")


def scan_html_links(pages: DataFrame, id: str, html: str, pattern: str, out: str = "link") -> DataFrame:
    """One row per match of ``pattern`` in the page: its first capture group."""
    return pages.select(id, F.explode(F.regexp_extract_all(F.col(html), F.lit(pattern), F.lit(1))).alias(out))


def scan_json_index(
    df: DataFrame,
    keep: Sequence[str],
    json: str,
    array: str,
    element: str,
    where: Column,
    field: str,
    out: str = "value",
) -> DataFrame:
    """Parse JSON, flatten its ``array``, keep elements that pass, give one ``field`` of each.

    ``element`` is the DDL of the fields needed; ``where`` speaks of them as ``item.<name>``. Text that
    is not JSON gives no rows.
    """
    parsed = F.from_json(F.col(json), f"struct<`{array}`: array<struct<{element}>>>")
    items = df.select(*keep, F.explode(parsed[array]).alias("item"))
    return items.where(where).select(*keep, F.col("item")[field].alias(out))


def scan_json_variants(
    df: DataFrame, keep: Sequence[str], json: str, array: str, fields: Mapping[str, tuple[str, str]]
) -> tuple[DataFrame, DataFrame]:
    """JSON whose shape varies by row: the elements of the array at path ``array``, and the rows that have none.

    ``fields`` gives each output column a path within the element and a type; what is not there, or has another type, is
    null. Returns ``keep`` and the fields, a row per element, and ``keep`` with a ``reason`` for every row left out:
    ``null``, ``not JSON``, or ``no array``. A row with an empty array is in neither. Paths read ``$.a.b[0]``.
    """
    parsed = df.select(F.struct(*keep).alias("_kept"), F.col(json).alias("_text"), F.try_parse_json(F.col(json)).alias("_json"))
    found = parsed.withColumn("_items", F.try_variant_get("_json", array, "array<variant>"))
    reason = (
        F.when(F.col("_text").isNull(), "null").when(F.col("_json").isNull(), "not JSON").when(F.col("_items").isNull(), "no array")
    )
    rejected = found.where(reason.isNotNull()).select("_kept.*", reason.alias("reason"))
    items = found.select("_kept", F.explode("_items").alias("_item"))
    values = [F.try_variant_get("_item", path, kind).alias(name) for name, (path, kind) in fields.items()]
    return items.select("_kept.*", *values), rejected
