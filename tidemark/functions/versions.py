"""Natural version order as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: what counts as a stable and as a preview version
STABLE = r"^[0-9]+[.][0-9]+[.][0-9]+\z"
PREVIEW = "[abrc]"

# Width of the length that is put before each number in a sort key: enough for any string
LENGTH_DIGITS = 10
# A tilde sorts before the end of the text, the end before digits and letters, these before signs.
SIGNS = "~+-.:_"
SIGN_CODES = "\x01\x7b\x7c\x7d\x7e\x7f"
END_CODE = "\x02"


def is_version(version: Column) -> Column:
    """Starts with a number."""
    return version.isNotNull() & version.rlike("^[0-9]")


def is_stable(version: Column) -> Column:
    return version.rlike(STABLE)


def is_preview(version: Column) -> Column:
    return version.rlike(PREVIEW)


def version_key(version: Column) -> Column:
    """Text that sorts, byte by byte, as versions do in ``sort -V``.

    Each number, however long, is led by its number of digits; signs are moved behind letters, and the
    version itself settles what is left (``1.01`` and ``1.1``). A bare version comes before its suffixed
    ones. Right for all that ``is_version``.
    """

    def led(part: Column) -> Column:
        digits = F.regexp_replace(part, "^0+(?=[0-9])", "")
        number = F.concat(F.lpad(F.length(digits).cast("string"), LENGTH_DIGITS, "0"), digits)
        return F.when(part.rlike("^[0-9]"), number).otherwise(F.translate(part, SIGNS, SIGN_CODES))

    parts = F.regexp_extract_all(version, F.lit("([0-9]+|[^0-9]+)"), F.lit(1))
    return F.concat(F.array_join(F.transform(parts, led), ""), F.lit(END_CODE), version)
