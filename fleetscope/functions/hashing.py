"""Stable 64-bit text hash used to spread clusters over workers."""

from pyspark.sql import Column, functions as F

MASK = 0xFFFFFFFF
HEX = "0123456789ABCDEF"


def _bytes(text: Column) -> Column:
    digits = F.hex(F.encode(text, "UTF-8"))

    def value(i):
        high = F.instr(F.lit(HEX), F.substring(digits, 2 * i - 1, 1)) - 1
        low = F.instr(F.lit(HEX), F.substring(digits, 2 * i, 1)) - 1
        return (high * 16 + low).cast("bigint")

    # plain ASCII, the usual case, needs no hex detour
    count = F.octet_length(text)
    plain = F.transform(F.sequence(F.lit(1), count), lambda i: F.ascii(F.substring(text, i, 1)).cast("bigint"))
    coded = F.transform(F.sequence(F.lit(1), count), value)
    return (
        F.when(count == 0, F.array().cast("array<bigint>"))
        .when(F.char_length(text) == count, plain)
        .otherwise(coded)
    )


def text_hash_bucket(cols: list[Column], buckets: int) -> Column:
    """``abs(h) mod buckets`` of h = 31*h + byte over UTF-8, wrapping at 64 bits.

    The wrap is kept in two 32-bit halves so that no step overflows a bigint.
    """
    text = F.concat(*[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    mask = F.lit(MASK).cast("bigint")

    def step(acc, byte):
        low = acc["lo"] * 31 + byte
        high = acc["hi"] * 31 + F.shiftright(low, 32)
        return F.struct(high.bitwiseAND(mask).alias("hi"), low.bitwiseAND(mask).alias("lo"))

    def absolute_bucket(acc):
        negative = acc["hi"] >= (1 << 31)
        low = F.when(negative, (mask + 1 - acc["lo"]).bitwiseAND(mask)).otherwise(acc["lo"])
        high = F.when(
            negative, (mask - acc["hi"] + F.when(acc["lo"] == 0, 1).otherwise(0)).bitwiseAND(mask)
        ).otherwise(acc["hi"])
        return ((high % buckets) * ((1 << 32) % buckets) + low) % buckets

    zero = F.struct(F.lit(0).cast("bigint").alias("hi"), F.lit(0).cast("bigint").alias("lo"))
    return F.aggregate(_bytes(text), zero, step, absolute_bucket)
