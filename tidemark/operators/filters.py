"""Row checks, filters and value mappings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.spread import lookup_join, spread_join


def rule_check(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Add ``violations`` (names of the rules broken, in rule order) and ``valid``.

    A rule that comes out null counts as broken: a missing value has no right format.
    """
    broken = [F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]
    checked = df.withColumn("violations", F.array_compact(F.array(*broken)))
    return checked.withColumn("valid", F.size("violations") == 0)


def allow_list_filter(
    df: DataFrame, col: str, allowed: Sequence | DataFrame, spread_by: Sequence[str] = ()
) -> DataFrame:
    """Keep rows whose ``col`` is in a short list, or in the first column of a table.

    For a table, ``spread_by`` names columns that tell rows of ``df`` apart.
    """
    if not isinstance(allowed, DataFrame):
        return df.where(F.col(col).isin(list(allowed)))
    values = allowed.select(F.col(allowed.columns[0]).alias(col)).distinct()
    return lookup_join(df, values, [col], "left_semi", spread_by or df.columns).select(*df.columns)


def exclude_pattern_filter(
    df: DataFrame, col: str, prefixes: Sequence[str] = (), names: Sequence[str] = ()
) -> DataFrame:
    """Drop rows whose ``col`` starts with one of the ``prefixes`` (regexps) or is one of ``names``."""
    out = df
    if prefixes:
        out = out.where(~F.coalesce(F.col(col).rlike("^(?:" + "|".join(prefixes) + ")"), F.lit(False)))
    if names:
        out = out.where(~F.coalesce(F.col(col).isin(list(names)), F.lit(False)))
    return out


def case_map(
    df: DataFrame,
    col: str,
    mapping: Mapping[str, Sequence[str]] | DataFrame,
    default: str,
    out: str,
    spread_by: Sequence[str] = (),
) -> DataFrame:
    """Map many values to one, with a default.

    ``mapping`` is ``{result: [values]}``, or for a long one a table of (value, result), values unique.
    """
    if isinstance(mapping, DataFrame):
        value, result = mapping.columns
        table = mapping.select(F.col(value).alias(col), F.col(result).alias("_mapped"))
        joined = lookup_join(df, table, [col], "left", spread_by or df.columns)
        return joined.withColumn(out, F.coalesce("_mapped", F.lit(default))).drop("_mapped")
    mapped = F.lit(default)
    for result, values in mapping.items():
        mapped = F.when(F.col(col).isin(list(values)), F.lit(result)).otherwise(mapped)
    return df.withColumn(out, mapped)


def default_fill(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Null, and in string columns the empty string, becomes the default."""
    types = dict(df.dtypes)
    filled = {}
    for name, value in defaults.items():
        present = F.nullif(F.col(name), F.lit("")) if types[name] == "string" else F.col(name)
        filled[name] = F.coalesce(present, F.lit(value).cast(types[name]))
    return df.withColumns(filled)


def longest_prefix(
    df: DataFrame, col: str, prefixes: DataFrame, out: str, spread_by: Sequence[str] = ()
) -> DataFrame:
    """Add ``out``: the longest of the ``prefixes`` (first column of a table, plain text) that ``col`` starts with, or null.

    The table may be of any size: each distinct value is cut to every length that a prefix has, and the cuts are looked up
    by an equi-join. ``spread_by`` names columns that tell rows of ``df`` apart. A null value has no prefix, a null prefix
    is none, and an empty one is a prefix of everything.
    """
    known = prefixes.select(F.col(prefixes.columns[0]).alias("_prefix")).where("_prefix is not null").distinct()
    lengths = known.agg(F.collect_set(F.length("_prefix")))  # no more numbers than the longest prefix has characters
    counts = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("_value")).agg(F.count(F.lit(1)).alias("_rows"))
    fitting = counts.withColumn("_length", F.explode(lengths.scalar())).where(F.col("_length") <= F.length("_value"))
    cuts = fitting.select("_value", F.substring("_value", F.lit(1), F.col("_length")).alias("_prefix"))
    found = lookup_join(cuts, known, ["_prefix"], "inner", ["_value"])
    found = found.groupBy("_value").agg(F.max_by("_prefix", F.length("_prefix")).alias("_longest"))
    columns = df.columns
    rows = df.withColumn("_value", F.col(col))
    joined = spread_join(rows, found, ["_value"], "left", spread_by or columns, counts)
    return joined.select(*columns, F.col("_longest").alias(out))


def exclude_prefix_table(df: DataFrame, col: str, prefixes: DataFrame, spread_by: Sequence[str] = ()) -> DataFrame:
    """``exclude_pattern_filter`` for prefixes in a table: drop rows whose ``col`` starts with one of them."""
    return longest_prefix(df, col, prefixes, "_longest_prefix", spread_by).where("_longest_prefix is null").select(*df.columns)
