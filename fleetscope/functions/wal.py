"""Write-ahead-log positions: text ``hex,hex/hex`` to a struct that orders by position."""

from pyspark.sql import Column, functions as F

POSITION = r"([0-9a-fA-F]+),([0-9a-fA-F]+)/([0-9a-fA-F]+)"
UINT32_MAX = 4294967295


def hex32(text: Column) -> Column:
    """Unsigned 32-bit value of a hex string; longer values saturate at 2^32-1."""
    digits = F.ltrim(text, F.lit("0"))
    return (
        F.when(F.length(digits) > 8, F.lit(UINT32_MAX).cast("bigint"))
        .when(F.length(digits) == 0, F.lit(0).cast("bigint"))
        .otherwise(F.conv(digits, 16, 10).cast("bigint"))
    )


def position(text: Column) -> Column:
    """First position in the text as struct(left, middle, right); 0,0/0 without a match.

    NULL text means that the position could not be asked for and stays NULL.
    """
    parts = [hex32(F.regexp_extract(text, POSITION, i)) for i in (1, 2, 3)]
    return F.when(
        text.isNotNull(),
        F.struct(parts[0].alias("left"), parts[1].alias("middle"), parts[2].alias("right")),
    )


def is_zero(pos: Column) -> Column:
    return (pos["left"] == 0) & (pos["middle"] == 0) & (pos["right"] == 0)


def to_text(pos: Column) -> Column:
    return F.format_string("%d,%d/%d", pos["left"], pos["middle"], pos["right"])
