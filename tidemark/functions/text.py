"""Text edits over string columns: one expression per edit, no line tables, no Python per row.

The flag ``d`` in the patterns makes only ``\\n`` a line end, as it is for line tools.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = r"[ \t\x0B\f\r]"  # white space within a line


def _quoted(text: str) -> str:
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def _as_replacement(text: Column | str) -> Column:
    """Text to be put in literally by ``regexp_replace``."""
    if isinstance(text, str):
        return F.lit(text.replace("\\", "\\\\").replace("$", "\\$"))
    return F.regexp_replace(text, r"([\\$])", r"\\$1")


def _as_column(text: Column | str) -> Column:
    return F.lit(text) if isinstance(text, str) else text


def _line_ended(text: Column) -> Column:
    return F.when((text == "") | text.endswith("\n"), text).otherwise(F.concat(text, F.lit("\n")))


def without_last_newline(text: Column) -> Column:
    """The text as lines see it: a newline at the very end opens no line."""
    return F.when(text.endswith("\n"), F.regexp_replace(text, r"\n\z", "")).otherwise(text)


def path_parts(df: DataFrame, col: str, prefix: str = "") -> DataFrame:
    """Add ``basename`` and ``dirname`` of a path or URL, as the commands of that name give them."""
    path = F.col(col)
    bare = F.regexp_replace(path, r"/+\z", "")
    parent = F.regexp_replace(bare, r"/+[^/]*\z", "")
    return df.withColumns(
        {
            prefix + "basename": F.when((bare == "") & (path != ""), "/").otherwise(
                F.substring_index(bare, "/", -1)
            ),
            prefix + "dirname": F.when(~bare.contains("/"), F.when(path.startswith("/"), "/").otherwise("."))
            .when(parent == "", "/")
            .otherwise(parent),
        }
    )


def split_around(df: DataFrame, col: str, sep: str, prefix: str = "") -> DataFrame:
    """Add the text before and after the first and the last ``sep``; all of it where there is none."""
    text, at = F.col(col), _quoted(sep)
    return df.withColumns(
        {
            prefix + "before_first": F.substring_index(text, sep, 1),
            prefix + "before_last": F.regexp_replace(text, rf"(?s)^(.*){at}.*\z", "$1"),
            prefix + "after_first": F.regexp_replace(text, rf"(?s)^.*?{at}(.*)\z", "$1"),
            prefix + "after_last": F.substring_index(text, sep, -1),
        }
    )


def url_template(
    df: DataFrame, version: str, templates: Sequence[tuple[int, str]], out: str = "url"
) -> DataFrame:
    """Fill the template of the highest major version reached.

    ``templates`` is (lowest major, text); the text may hold ``{version}``, ``{name}`` (version without
    its last dotted part), ``{major}``, ``{main}`` and ``{build}`` (before and after ``+``). Values are
    put in with ``+`` written as ``%2B``. Below the lowest major the URL is null.
    """
    text = F.col(version)
    major = F.substring_index(text, ".", 1)
    values = {
        "version": text,
        "name": F.regexp_replace(text, r"[.][^.]*\z", ""),
        "major": major,
        "main": F.regexp_replace(text, r"[+][^+]*\z", ""),
        "build": F.regexp_replace(text, r"^[^+]*[+]", ""),
    }

    def fill(template: str) -> Column:
        parts = []
        for piece in template.replace("{", "\0{").replace("}", "}\0").split("\0"):
            if piece.startswith("{"):
                parts.append(F.replace(values[piece[1:-1]], F.lit("+"), F.lit("%2B")))
            elif piece:
                parts.append(F.lit(piece))
        return F.concat(*parts)

    url = F.lit(None).cast("string")
    for lowest, template in sorted(templates):
        url = F.when(major.try_cast("int") >= lowest, fill(template)).otherwise(url)
    return df.withColumn(out, url)


def regex_rewrite(df: DataFrame, col: str, pattern: str, replacement: str, out: str | None = None) -> DataFrame:
    """Rewrite every match; ``$1`` in the replacement is the first capture group."""
    return df.withColumn(out or col, F.regexp_replace(F.col(col), pattern, replacement))


def regex_pick(df: DataFrame, col: str, pattern: str, out: str) -> DataFrame:
    """First capture group of the first match, empty where nothing matches."""
    return df.withColumn(out, F.regexp_extract(F.col(col), pattern, 1))


def field_split(df: DataFrame, col: str, names: Sequence[str]) -> DataFrame:
    """White-space separated fields into columns; null where there are fewer fields than names."""
    fields = F.regexp_extract_all(F.col(col), F.lit(r"([^ \t\n]+)"), F.lit(1))
    return df.withColumns({name: F.get(fields, F.lit(i)) for i, name in enumerate(names)})


def tail_lines(df: DataFrame, text: str, n: int, out: str = "tail") -> DataFrame:
    """The last ``n`` lines joined by blanks and trimmed."""
    joined = F.translate(F.substring_index(without_last_newline(F.col(text)), "\n", -n), "\n", " ")
    return df.withColumn(out, F.regexp_replace(joined, r"^[ \t\x0B\f\r]+|[ \t\x0B\f\r]+\z", ""))


def comment_out_lines(
    df: DataFrame, text: str, pattern: str, mark: str = "#", idempotent: bool = True
) -> DataFrame:
    """Put ``mark`` before each line that matches. Marked lines are left alone unless ``idempotent=False``."""
    unmarked = f"(?!{_quoted(mark)})" if idempotent else ""
    # most texts have no such line, which a plain search finds sooner
    marked = F.regexp_replace(F.col(text), rf"(?md)^{unmarked}(?=.*?(?:{pattern}))", _as_replacement(mark))
    return df.withColumn(text, F.when(F.col(text).rlike(f"(?md){pattern}"), marked).otherwise(F.col(text)))


def replace_or_append_kv(
    df: DataFrame, text: str, key: str, value: Column | str, style: str = "space"
) -> DataFrame:
    """Replace every line that sets ``key``; append one where there is none.

    ``style='space'``: lines ``key value``, commented ones count and are uncommented.
    ``style='export'``: lines ``export key="value"``.
    """
    if style == "space":
        found = rf"(?md)^{BLANK}*#?{BLANK}*{_quoted(key)}{BLANK}+.*$"
        line = F.concat(F.lit(key + " "), _as_column(value))
    elif style == "export":
        found = rf"(?md)^export{BLANK}+{_quoted(key)}=.*$"
        line = F.concat(F.lit(f'export {key}="'), _as_column(value), F.lit('"'))
    else:
        raise ValueError(f"unknown style: {style}")
    body = F.col(text)
    return df.withColumn(
        text,
        F.when(body.rlike(found), F.regexp_replace(body, F.lit(found), _as_replacement(line))).otherwise(
            F.concat(_line_ended(body), line, F.lit("\n"))
        ),
    )


def block_upsert_tail(df: DataFrame, text: str, begin: str, end: str, body: Column | str) -> DataFrame:
    """Delete every marked block and put the new one last.

    A line is a marker when it contains the marker text; a block without an end reaches to the end of
    the text.
    """
    block = (
        rf"(?msd)^[^\n]*?{_quoted(begin)}[^\n]*$.*?(?:^[^\n]*?{_quoted(end)}[^\n]*$\n?|\z)"
    )
    whole = F.col(text)
    rest = F.when(whole.contains(begin), F.regexp_replace(whole, block, "")).otherwise(whole)
    return df.withColumn(
        text, F.concat(_line_ended(rest), F.lit(begin + "\n"), _as_column(body), F.lit(f"\n{end}\n"))
    )


def block_replace_in_place(df: DataFrame, text: str, begin: str, end: str, body: Column | str) -> DataFrame:
    """Give every marked block a new body where it stands; append a block where there is none.

    Markers are whole lines. A block without an end loses the rest of the text, or all up to the next
    begin marker.
    """
    start = rf"(?msd)^{_quoted(begin)}$"
    block = rf"{start}.*?(?:^({_quoted(end)})$|(?=^{_quoted(begin)}$)|\z)"
    whole = F.col(text)
    replaced = F.concat(_as_replacement(begin + "\n"), _as_replacement(body), F.lit("\n$1"))
    appended = F.concat(
        _line_ended(whole), F.lit(f"\n{begin}\n"), _as_column(body), F.lit(f"\n{end}\n")
    )
    return df.withColumn(
        text,
        F.when(whole.rlike(start), F.regexp_replace(whole, F.lit(block), replaced)).otherwise(appended),
    )
