"""Resource quantities such as ``500m``, ``2Gi`` or ``1T``."""

from pyspark.sql import Column, functions as F

PATTERN = r"^([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+))(|[numkMGTPE]|[KMGTPE]i|[eE][+-]?[0-9]{1,2})$"

# fixed values: how a rate is written; multiplier of each suffix, in billionths
RATE = r"([0-9.]+)(Ki|K|Mi|Gi|M|G|Ti|T)"
SCALE = {
    "n": 1, "u": 10**3, "m": 10**6, "": 10**9,
    "k": 10**12, "M": 10**15, "G": 10**18, "T": 10**21, "P": 10**24, "E": 10**27,
    "Ki": 2**10 * 10**9, "Mi": 2**20 * 10**9, "Gi": 2**30 * 10**9,
    "Ti": 2**40 * 10**9, "Pi": 2**50 * 10**9, "Ei": 2**60 * 10**9,
}


_TABLE = "map(" + ", ".join(f"'{k}', cast('{v}' as decimal(28,0))" for k, v in SCALE.items()) + ")"


def is_quantity(text: Column) -> Column:
    """Blank counts as valid, like an absent value."""
    return (F.coalesce(text, F.lit("")) == "") | text.rlike(PATTERN)


def billionths(text: Column) -> Column:
    """Value in billionths, exact up to 32 digits and the largest such number beyond; NULL when the text is blank or no quantity."""
    number = F.regexp_extract(text, PATTERN, 1).try_cast("decimal(30,6)")
    suffix = F.regexp_extract(text, PATTERN, 2)
    power = F.substring(suffix, 2, 3).try_cast("int")
    scientific = (number.cast("double") * F.pow(F.lit(10.0), power + 9)).try_cast("decimal(38,6)")
    exact = F.try_multiply(number, F.try_element_at(F.expr(_TABLE), suffix))
    largest = F.lit("9" * 32).cast("decimal(38,6)")
    beyond = F.when(text.rlike(PATTERN), F.when(F.startswith(text, F.lit("-")), -largest).otherwise(largest))
    return F.coalesce(exact, F.when(F.length(suffix) > 1, scientific), beyond)


def amount(text: Column) -> Column:
    return (billionths(text) / F.lit(10**9)).cast("decimal(38,6)")


def compare(left: Column, right: Column) -> Column:
    """-1, 0 or 1; text without a valid quantity counts as zero. Equal texts are not parsed."""
    zero = F.lit(0).cast("decimal(38,6)")
    a, b = F.coalesce(billionths(left), zero), F.coalesce(billionths(right), zero)
    return F.when(left == right, 0).when(a > b, 1).when(a < b, -1).otherwise(0)


def network_rate(text: Column) -> Column:
    """Bandwidth as whole megabits, rounded up."""
    number = F.regexp_extract(text, RATE, 1).try_cast("double")
    unit = F.regexp_extract(text, RATE, 2)
    return F.ceil(
        F.when(unit.contains("G"), number * 1000).when(unit.contains("T"), number * 1000000).otherwise(number)
    )
