"""Windows over a key whose history may be too large for one task.

A plain ``Window.partitionBy(key)`` puts the whole history of a key into one task. Here the
rows of a key are cut into chunks along the order, the window runs inside each (key, chunk), and
what a chunk needs from its neighbours is taken from one summary row per chunk. The result equals
the plain window exactly.

A chunk is either a column (a function of the order that never decreases along it), or ``ByCount``:
rows are first counted in small buckets along the order, and the buckets of a key are laid together
until a chunk has enough rows. Counts and summaries come out of one partial aggregate; only keys
of more than one chunk are in the table of cuts, so that most rows meet no partner there.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

CHUNK = "_chunk"
_BUCKET = "_bucket"


@dataclass(frozen=True)
class ByCount:
    """Chunks of about ``rows`` rows. ``bucket`` never decreases along the order; one bucket's rows of a key fit in a task."""

    bucket: Column
    rows: int = 1_000_000


def by_minute(ts: str, rows: int = 1_000_000) -> ByCount:
    return ByCount(F.date_trunc("minute", F.col(ts)), rows)


@dataclass(frozen=True)
class Measure:
    """One window value.

    inside    value seen from within the chunk
    summary   aggregate of one chunk
    carry     value over the chunk summaries (columns named ``_s_<name>``)
    combine   final value from the inside value and the carry
    back      the carry comes from earlier chunks, not from later ones
    """

    inside: object
    summary: object
    carry: object
    combine: object
    back: bool = True


def lag(value: Column, order: list[Column]) -> Measure:
    boxed = F.struct(value.alias("v"))
    return Measure(
        lambda w: F.lag(boxed).over(w),
        lambda: F.max_by(boxed, F.struct(*order)),
        lambda s, wc: F.lag(s).over(wc),
        lambda inside, carry: F.coalesce(inside, carry)["v"],
    )


def lead(value: Column, order: list[Column]) -> Measure:
    boxed = F.struct(value.alias("v"))
    return Measure(
        lambda w: F.lead(boxed).over(w),
        lambda: F.min_by(boxed, F.struct(*order)),
        lambda s, wc: F.lead(s).over(wc),
        lambda inside, carry: F.coalesce(inside, carry)["v"],
        back=False,
    )


def running_sum(value: Column) -> Measure:
    """Sum up to and including the current row."""
    return Measure(
        lambda w: F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        lambda: F.sum(value),
        lambda s, wc: F.sum(s).over(wc.rowsBetween(Window.unboundedPreceding, -1)),
        lambda inside, carry: F.coalesce(inside, F.lit(0)) + F.coalesce(carry, F.lit(0)),
    )


def last_known(value: Column, order: list[Column]) -> Measure:
    """Latest non-NULL value up to and including the current row."""
    return Measure(
        lambda w: F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        lambda: F.max_by(value, F.when(value.isNotNull(), F.struct(*order))),
        lambda s, wc: F.last(s, ignorenulls=True).over(wc.rowsBetween(Window.unboundedPreceding, -1)),
        lambda inside, carry: F.coalesce(inside, carry),
    )


def with_measures(
    df: DataFrame, key: list[str], order: list[Column], chunk: Column | ByCount | None, **measures: Measure
) -> DataFrame:
    """Add one column per measure; ``chunk=None`` runs plain windows for histories known to be short."""
    if isinstance(chunk, ByCount):
        return _by_count(df, key, order, chunk, measures)
    if chunk is None:
        w = Window.partitionBy(*key).orderBy(*order)
        return df.withColumns({n: m.combine(m.inside(w), F.lit(None)) for n, m in measures.items()})
    rows = df.withColumn(CHUNK, chunk)
    w = Window.partitionBy(*key, CHUNK).orderBy(*order)
    wc = Window.partitionBy(*key).orderBy(CHUNK)
    inside = rows.withColumns({f"_i_{n}": m.inside(w) for n, m in measures.items()})
    summaries = rows.groupBy(*key, CHUNK).agg(*[m.summary().alias(f"_s_{n}") for n, m in measures.items()])
    carries = summaries.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)],
        F.col(CHUNK).alias("_kc"),
        *[m.carry(F.col(f"_s_{n}"), wc).alias(f"_c_{n}") for n, m in measures.items()],
    )
    on = F.col(CHUNK) == F.col("_kc")
    for i, k in enumerate(key):
        on = on & (F.col(k) == F.col(f"_k{i}"))
    joined = inside.join(carries, on, "left")
    return joined.select(
        *df.columns,
        *[m.combine(F.col(f"_i_{n}"), F.col(f"_c_{n}")).alias(n) for n, m in measures.items()],
    )


def _totals(summaries: DataFrame, key: list[str], size: int) -> DataFrame:
    """Bucket summaries (with ``_n`` rows) of keys over ``size`` rows, each with its chunk."""
    whole = Window.partitionBy(*key)
    upto = whole.orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    hot = summaries.withColumn("_all", F.sum("_n").over(whole)).where(F.col("_all") > size)
    return hot.withColumn(CHUNK, F.floor(F.coalesce(F.sum("_n").over(upto), F.lit(0)) / size))


def _with_cuts(df: DataFrame, key: list[str], bucket: Column, cuts: DataFrame) -> DataFrame:
    """Rows with the columns that ``cuts`` has for their key and bucket; NULL for keys that have no cuts."""
    named = cuts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], F.col(_BUCKET).alias("_kb"), *[c for c in cuts.columns if c not in key and c != _BUCKET])
    rows = df.withColumn(_BUCKET, bucket)
    on = rows[_BUCKET] == named["_kb"]
    for i, k in enumerate(key):
        on = on & (rows[k] == named[f"_k{i}"])
    return rows.join(named, on, "left").drop(*[f"_k{i}" for i in range(len(key))], "_kb", _BUCKET)


def _by_count(df: DataFrame, key: list[str], order: list[Column], chunk: ByCount, measures: dict[str, Measure]) -> DataFrame:
    """``with_measures`` in two scans: one for counts and summaries of buckets, one for the rows."""
    buckets = df.withColumn(_BUCKET, chunk.bucket).groupBy(*key, _BUCKET).agg(
        F.count("*").alias("_n"), *[m.summary().alias(f"_s_{n}") for n, m in measures.items()])
    wb = Window.partitionBy(*key).orderBy(_BUCKET)
    hot = _totals(buckets, key, chunk.rows).withColumns({f"_b_{n}": m.carry(F.col(f"_s_{n}"), wb) for n, m in measures.items()})
    # what comes into a chunk is what comes into its first bucket, or into its last one from behind
    inside = Window.partitionBy(*key, CHUNK).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cuts = hot.select(*key, _BUCKET, CHUNK, *[
        (F.first if m.back else F.last)(F.struct(F.col(f"_b_{n}").alias("v"))).over(inside)["v"].alias(f"_c_{n}") for n, m in measures.items()])
    rows = _with_cuts(df, key, chunk.bucket, cuts)
    w = Window.partitionBy(*key, CHUNK).orderBy(*order)
    seen = rows.withColumns({f"_i_{n}": m.inside(w) for n, m in measures.items()})
    return seen.select(*df.columns, *[m.combine(F.col(f"_i_{n}"), F.col(f"_c_{n}")).alias(n) for n, m in measures.items()])


def islands(df: DataFrame, key: list[str], order: list[str], value: Column, chunk: Column | ByCount | None, with_chunk: bool = False) -> DataFrame:
    """Rows at which ``value`` changes, the first of a key included: key, order, ``value``, ``previous``, ``next_at``, ``next_value``.

    ``next_at`` is ``order[0]`` of the key's next change. Two scans: one counts buckets by value, with the first and last
    place of each, which tells what every chunk begins and ends with and where it first changes; one reads the rows.
    ``with_chunk`` keeps the column ``_chunk``, null for keys of one chunk.
    """
    at = F.struct(*order)
    rows = df.select(*df.columns, F.struct(value.alias("value")).alias("_v"))
    parts, before, after = key, F.lit(None), F.lit(None)
    if chunk is not None:
        chunk = chunk if isinstance(chunk, ByCount) else ByCount(chunk, 1)
        parts, before, after = [*key, CHUNK], F.col("_before"), F.col("_after")
        spans = rows.withColumn(_BUCKET, chunk.bucket).groupBy(*key, _BUCKET, "_v").agg(F.count("*").alias("_n"), F.min(at).alias("_from"), F.max(at).alias("_to"))
        whole, one, bucket = Window.partitionBy(*key), Window.partitionBy(*key, CHUNK), Window.partitionBy(*key, _BUCKET)
        earlier = whole.orderBy(CHUNK).rangeBetween(Window.unboundedPreceding, -1)
        later = whole.orderBy(F.desc(CHUNK)).rangeBetween(Window.unboundedPreceding, -1)
        hot = spans.withColumn("_all", F.sum("_n").over(whole)).where(F.col("_all") > chunk.rows)
        # the default frame holds all values of the bucket
        hot = hot.withColumn(CHUNK, F.floor((F.sum("_n").over(whole.orderBy(_BUCKET)) - F.sum("_n").over(bucket)) / chunk.rows))
        hot = hot.withColumns({"_first": F.min_by("_v", "_from").over(one), "_start": F.min("_from").over(one), "_before": F.max_by("_v", "_to").over(earlier)})
        other = F.min(F.when(~F.col("_v").eqNullSafe(F.col("_first")), F.struct(F.col("_from").alias("at"), F.col("_v").alias("v")))).over(one)
        starts = F.struct(F.col("_start").alias("at"), F.col("_first").alias("v"))
        hot = hot.withColumn("_change", F.when(F.col("_before").isNull() | ~F.col("_before").eqNullSafe(F.col("_first")), starts).otherwise(other))
        hot = hot.withColumns({"_after": F.min("_change").over(later), "_row": F.row_number().over(bucket.orderBy("_from"))})
        rows = _with_cuts(rows, key, chunk.bucket, hot.where("_row = 1").select(*key, _BUCKET, CHUNK, "_before", "_after"))
    w = Window.partitionBy(*parts).orderBy(*order)
    seen = rows.withColumn("_prev", F.coalesce(F.lag("_v").over(w), before) if chunk is not None else F.lag("_v").over(w))
    changes = seen.where(F.col("_prev").isNull() | ~F.col("_prev").eqNullSafe(F.col("_v")))
    follows = F.lead(F.struct(at.alias("at"), F.col("_v").alias("v"))).over(w)
    changes = changes.withColumn("_next", F.coalesce(follows, after) if chunk is not None else follows)
    return changes.select(
        *df.columns, F.col("_v.value").alias("value"), F.col("_prev.value").alias("previous"),
        F.col("_next")["at"][order[0]].alias("next_at"), F.col("_next")["v"]["value"].alias("next_value"),
        *([F.col(CHUNK) if chunk is not None else F.lit(None).cast("bigint").alias(CHUNK)] if with_chunk else []))


def with_previous(df: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """Adds ``_prev``: ``value`` of the key's row before, for rows that carry ``_chunk`` as ``islands`` leaves it, in their partitions.

    Only the first and last row of each chunk meet in a window over the key; all others are spread by a hash. It reads
    its input once.
    """
    boxed = F.struct(F.col(value).alias("v"))
    w = Window.partitionBy(*key, CHUNK).orderBy(*order)
    rows = df.withColumns({"_in": F.lag(boxed).over(w), "_out": F.lead(boxed).over(w)})
    edge = F.col(CHUNK).isNotNull() & (F.col("_in").isNull() | F.col("_out").isNull())
    rows = rows.withColumn("_side", F.when(edge, -1).otherwise(F.pmod(F.xxhash64(*order), F.lit(1 << 20))))
    across = F.lag(boxed).over(Window.partitionBy(*key, "_side").orderBy(*order))
    return rows.select(*df.columns, F.coalesce("_in", F.when(edge, across))["v"].alias("_prev"))


def run_lengths(df: DataFrame, key: list[str], order: list[Column], ok: Column, chunk: Column | ByCount | None) -> DataFrame:
    """Failures since the last success: ``run_before`` excludes and ``run_length`` includes the row."""
    parts = key if chunk is None else [*key, CHUNK]
    rows = df
    if isinstance(chunk, ByCount):
        buckets = df.select(*key, chunk.bucket.alias(_BUCKET)).groupBy(*key, _BUCKET).agg(F.count("*").alias("_n"))
        rows = _with_cuts(df, key, chunk.bucket, _totals(buckets, key, chunk.rows).select(*key, _BUCKET, CHUNK))
        rows = rows.withColumn(CHUNK, F.coalesce(CHUNK, F.lit(0)))
    elif chunk is not None:
        rows = df.withColumn(CHUNK, chunk)
    w = Window.partitionBy(*parts).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_fail", F.when(ok, 0).otherwise(1).cast("bigint"))
    rows = rows.withColumn("_fails", F.sum("_fail").over(upto))
    mark = F.when(F.col("_fail") == 0, F.col("_fails"))
    rows = rows.withColumns({"_mark": F.max(mark).over(upto), "_mark_before": F.max(mark).over(before)})
    carry = F.lit(0).cast("bigint")
    if chunk is not None:
        # failures of the chunk, and how many of them came up to its last success
        ends = rows.groupBy(*parts).agg(F.max("_fails").alias("_total"), F.max("_mark").alias("_at_ok"))
        wc = Window.partitionBy(*key).orderBy(CHUNK)
        earlier = wc.rowsBetween(Window.unboundedPreceding, -1)
        ends = ends.withColumn("_sum", F.coalesce(F.sum("_total").over(earlier), F.lit(0)))
        ends = ends.withColumn("_base", F.last(F.col("_sum") + F.col("_at_ok"), ignorenulls=True).over(earlier))
        ends = ends.select(
            *[F.col(k).alias(f"_k{i}") for i, k in enumerate(parts)],
            (F.col("_sum") - F.coalesce(F.col("_base"), F.lit(0))).alias("_carry"),
        )
        on = F.lit(True)
        for i, k in enumerate(parts):
            on = on & (F.col(k) == F.col(f"_k{i}"))
        rows = rows.join(ends, on, "left")
        carry = F.coalesce(F.col("_carry"), F.lit(0))

    def since(fails, marked):
        return F.when(marked.isNotNull(), fails - marked).otherwise(fails + carry)

    return rows.select(
        *df.columns,
        since(F.col("_fails") - F.col("_fail"), F.col("_mark_before")).alias("run_before"),
        since(F.col("_fails"), F.col("_mark")).alias("run_length"),
    )
