"""Line dedup over all documents: copies of a line, and lines one edit apart, go; the earliest stays.

Lines one edit apart share a variant: deleting one character of each, at the same place, gives the same
string if a character was replaced, and deleting one of the longer gives the shorter otherwise. So the lines
around a variant are compared with the earliest of them, never with each other, and there are no more of them
than characters that can stand at a place.

A line of n characters has n variants of n characters, but they are not spelled out: a variant is cut into what
comes before a block of about the root of its length, the block, and what comes after it. The outer parts are
hashed once for all variants that delete within the block, so the work grows with n to the power of 1.5.

Before variants are made, lines that cannot have a partner are left out: an edit changes one half of a line only,
so the other half has to occur in a line of like length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import whole, written
from tidemark.operators.spread import lookup_join, spread_join

NEAR_CHARS = 20
LINE = ["_h1", "_h2"]  # 128 bits of hash stand for a line


def _lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(_key, _pos, _line, _chars) of all lines that are not blank."""
    lines = docs.select(F.col(key).alias("_key"), F.posexplode(F.split(whole(F.col(text)), "\n")).alias("_pos", "_line"))
    lines = lines.where(F.length(F.trim(F.translate("_line", "\t\r\x0b\x0c", "    "))) > 0)
    return lines.select(
        "*",
        F.length("_line").alias("_chars"),
        F.xxhash64("_line").alias("_h1"),
        F.xxhash64(F.lit(1), "_line").alias("_h2"),
    )


def _halves() -> Column:
    """Hashes of the halves that a line has in common with any line one edit away: of its own length, of one
    more (it being the shorter) or of one less. The shorter length is part of the hash."""
    found = []
    for shorter in (F.col("_chars"), F.col("_chars") - 1):
        half = F.floor(shorter / 2).cast("int")
        found += [
            F.xxhash64(shorter, F.lit(0), F.substring("_line", F.lit(1), half)),
            F.xxhash64(shorter, F.lit(1), F.substring("_line", F.col("_chars") - half + 1, half)),
        ]
    return F.array(*found)


def _partnered(lines: DataFrame) -> DataFrame:
    """Of distinct lines (LINE, _first, _halves) those with a half that another line has too."""
    halves = lines.select(*LINE, F.explode("_halves").alias("_half"))
    counts = halves.groupBy("_half").agg(F.count(F.lit(1)).alias("_rows"))
    shared = counts.where("_rows > 1").select("_half")
    found = spread_join(halves, shared, ["_half"], "left_semi", LINE, counts)
    return found.select(*LINE).distinct()


def _variants(lines: DataFrame, deleting: bool) -> DataFrame:
    """(_me, _at, _variant): hashes of the lines (_me, _line, _chars) without their character _at, or of the lines
    themselves (_at 0), which may be variants of longer ones and have a hash for each block.

    A variant of n characters has blocks of ceil(sqrt(n)); its hash is made of n, the number of a block, and the
    hashes of the parts before it, of the block and of the part after it.
    """
    size = F.col("_chars") - (1 if deleting else 0)
    step = F.ceil(F.sqrt(size)).cast("int")
    cut = lines.select("_me", "_line", size.alias("_n"), step.alias("_step"))
    last = F.floor((F.col("_n") - 1) / F.col("_step")).cast("int")
    blocks = cut.select("_me", "_line", "_n", "_step", F.explode(F.sequence(F.lit(0), last)).alias("_block"))
    start = F.col("_block") * F.col("_step")  # characters before the block
    width = F.least(F.col("_step"), F.col("_n") - start) + (1 if deleting else 0)
    before, after = F.substring("_line", F.lit(1), start), F.substring("_line", start + width + 1, F.col("_n") + 1)
    middle = F.substring("_line", start + 1, width)
    outer = F.xxhash64("_n", "_block", F.xxhash64(before), F.xxhash64(F.lit(1), after)).alias("_outer")
    parts = blocks.select("_me", outer, middle.alias("_middle"), start.alias("_start"), width.alias("_width"))
    if not deleting:
        return parts.select("_me", F.lit(0).alias("_at"), F.xxhash64("_outer", "_middle").alias("_variant"))
    places = parts.select("*", F.explode(F.sequence(F.lit(1), F.col("_width"))).alias("_i"))
    without = F.concat(F.expr("substring(_middle, 1, _i - 1)"), F.expr("substring(_middle, _i + 1)"))
    return places.select("_me", (F.col("_start") + F.col("_i")).alias("_at"), F.xxhash64("_outer", without).alias("_variant"))


def _earlier(lines: DataFrame) -> DataFrame:
    """(LINE, _near, _near_at, _at): for each of the distinct lines (LINE, _first, _line, _chars) the earliest line before it
    that is one edit away, as a struct of its place and hashes; and the places (_at, _near_at) that make both equal
    if their characters are left out."""
    me = F.struct(F.col("_first._key").alias("_key"), F.col("_first._pos").alias("_pos"), *LINE)
    base = lines.select(me.alias("_me"), "_line", "_chars")
    variants = _variants(base.where("_chars > 1"), True).unionByName(_variants(base, False))
    around = variants.repartition("_variant").withColumn("_here", F.struct("_me.*", "_at"))
    replaced = F.min("_here").over(Window.partitionBy("_variant", "_at"))
    whole_line = F.when(F.col("_at") == 0, F.col("_here"))
    longer = F.when(F.col("_at") > 0, F.col("_here"))
    group = Window.partitionBy("_variant")
    found = around.select("_me", "_at", replaced.alias("_r"), F.min(whole_line).over(group).alias("_s"), F.min(longer).over(group).alias("_l"))
    best = F.when(F.col("_at") == 0, F.col("_l")).otherwise(F.least("_r", "_s"))
    found = found.select("_me", "_at", best.alias("_best"))
    found = found.select("_me", "_at", F.struct(*[f"_best.{c}" for c in ("_key", "_pos", *LINE)]).alias("_near"), F.col("_best._at").alias("_near_at"))
    found = found.where(F.col("_near_at").isNotNull() & (F.col("_near") < F.col("_me")))
    best = F.min(F.struct("_near", "_near_at", "_at")).alias("_best")
    return found.groupBy(*[F.col(f"_me.{h}").alias(h) for h in LINE]).agg(best).select(*LINE, "_best.*")


def _without_char(line: str, at: str) -> Column:
    """A line without the character at a place counted from 1, or as it is at place 0."""
    left = F.concat(F.expr(f"substring({line}, 1, {at} - 1)"), F.expr(f"substring({line}, {at} + 1)"))
    return F.when(F.col(at) == 0, F.col(line)).otherwise(left)


def repeated_lines(docs: DataFrame, key: str, text: str, near_chars: int = NEAR_CHARS) -> DataFrame:
    """(key, pos, keep_key, keep_pos, edits): every line to be removed, and the earliest line that it repeats.

    Lines are what line feeds separate, numbered from 0; the order is that of key (null first) and number. A
    line is removed if an equal line comes before it (edits 0), or else, for lines of ``near_chars``
    characters or more, if one as long as that comes before it that differs by one character put in, left out or
    replaced (edits 1); whether that line stays itself does not matter. Blank lines are left alone, and lines may
    have any length.

    A null or empty text has no lines to remove. Rows that repeat a key are taken for one document: lines of
    the same number and content are one line. Other columns are ignored; an empty table gives no rows.
    """
    lines = _lines(docs, key, text)
    long_enough = F.col("_chars") >= near_chars
    places = written(lines.select("_key", "_pos", "_chars", *LINE, F.when(long_enough, _halves()).alias("_halves")), "lines")
    first = F.min(F.struct("_key", "_pos")).alias("_first")
    distinct = places.groupBy(*LINE).agg(
        first, F.count(F.lit(1)).alias("_rows"), F.min("_halves").alias("_halves"), F.min("_chars").alias("_chars")
    )
    distinct = written(distinct, "distinct-lines")
    candidates = _partnered(distinct.where(F.col("_halves").isNotNull()))
    candidates = distinct.join(candidates, LINE).select(*LINE, "_first")
    candidates = written(candidates, "candidate-lines")

    texts = lookup_join(lines, candidates, LINE, "inner", ["_key", "_pos"])
    texts = texts.where(F.struct("_key", "_pos") == F.col("_first")).dropDuplicates(LINE)
    texts = written(texts.select(*LINE, "_first", "_line", "_chars"), "candidate-texts")
    near = written(_earlier(texts), "near-lines")
    here = texts.select(*LINE, "_line")
    there = texts.select(*[F.col(h).alias(f"_near{h}") for h in LINE], F.col("_line").alias("_near_line"))
    near = near.select(*LINE, "_near", "_near_at", "_at", *[F.col(f"_near.{h}").alias(f"_near{h}") for h in LINE])
    near = near.join(here, LINE).join(there, [f"_near{h}" for h in LINE])
    # one edit, verified in linear time: what is left without the two characters is equal, and the lines are not
    equal = _without_char("_line", "_at") == _without_char("_near_line", "_near_at")
    near = near.where(equal & (F.col("_line") != F.col("_near_line"))).select(*LINE, "_near")
    near = written(near, "verified-lines")

    found = distinct.select(*LINE, "_first", "_rows").join(near, LINE, "left")
    found = found.where((F.col("_rows") > 1) | F.col("_near").isNotNull())
    counts = found.select(*LINE, "_rows")
    # what is kept of a line that has copies and a near one: later copies repeat the earlier equal line
    removed = spread_join(places.select("_key", "_pos", *LINE), found.drop("_rows"), LINE, "inner", ["_key", "_pos"], counts)
    here = F.struct("_key", "_pos")
    copy = here != F.col("_first")
    removed = removed.where(copy | F.col("_near").isNotNull())
    return removed.select(
        F.col("_key").alias(key),
        F.col("_pos").alias("pos"),
        F.when(copy, F.col("_first._key")).otherwise(F.col("_near._key")).alias("keep_key"),
        F.when(copy, F.col("_first._pos")).otherwise(F.col("_near._pos")).alias("keep_pos"),
        F.when(copy, 0).otherwise(1).alias("edits"),
    )


def drop_lines(docs: DataFrame, key: str, text: str, removed: DataFrame) -> DataFrame:
    """``docs`` with the lines of ``removed`` (key, pos) taken out of ``text``; all columns and rows stay."""
    gone = removed.groupBy(F.col(key).alias("_gone_key")).agg(F.collect_list("pos").alias("_gone"))
    joined = docs.join(gone, docs[key].eqNullSafe(gone["_gone_key"]), "left")
    parts = F.split(F.col(text), "\n")
    kept = F.array_join(F.filter(parts, lambda line, at: ~F.array_contains("_gone", at)), "\n")
    return joined.withColumn(text, F.when(F.col("_gone").isNull(), F.col(text)).otherwise(kept)).drop("_gone", "_gone_key")
