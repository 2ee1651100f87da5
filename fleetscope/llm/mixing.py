"""Mixing sources to target weights: hierarchical budgets over domain, language and source, in DataFrame operations only.

Weights go down a tree. A node's budget is shared among its children by weight; a child that has fewer
tokens than its share gives the rest to its siblings, and only what a whole family cannot supply goes
back to the family's own siblings. Every leaf then takes whole seeded epochs of its documents and a
token-prefix of one more.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import common

LEVELS = ("domain", "lang", "source")
#: production weights of the query: integers, for siblings of one family; 1 for a name that is not listed
WEIGHTS = {("crawl",): 5, ("books",): 3, ("forums",): 2, ("crawl", "en"): 4, ("books", "en"): 3, ("forums", "en"): 3}
SEED = 42
_WIDE = "decimal(38,0)"


def domain_of(source: Column) -> Column:
    """Domain of a source: src0 is a crawl, src1 to src9 are books, the others forums."""
    return F.when(source == "src0", "crawl").when(source.rlike("^src[1-9]$"), "books").otherwise("forums")


def words_in(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _weight(weights, path: list[Column]) -> Column:
    depth, out = len(path), None
    for names, weight in weights.items():
        if len(names) == depth:
            same = path[0].eqNullSafe(names[0])
            for column, name in zip(path[1:], names[1:]):
                same = same & column.eqNullSafe(name)
            out = F.when(same, weight) if out is None else out.when(same, weight)
    return (F.lit(1) if out is None else out.otherwise(1)).cast("long")


def shared_out(children: DataFrame, family: list[str], name: str) -> DataFrame:
    """Adds ``target``: each family's ``budget`` among its children by ``weight``, none over its ``capacity``.

    Children in order of capacity per weight; those before the first one that can take its full share of
    what is left are used up, the others share the rest in proportion, with whole tokens dealt by running
    totals in order of name, so that a family's targets add up to min(budget, capacity) exactly.
    """
    wide = lambda c: F.col(c).cast(_WIDE)
    order = Window.partitionBy(*family).orderBy((F.col("capacity") / F.col("weight")).asc(), F.col(name).asc_nulls_first())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = children.withColumns({
        "__used": F.coalesce(F.sum("capacity").over(before), F.lit(0)),
        "__weights": F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)),
    })
    left = F.greatest(wide("budget") - wide("__used"), F.lit(0).cast(_WIDE))
    rows = rows.withColumn("__full", (wide("capacity") * wide("__weights") <= left * wide("weight")))
    family_of = Window.partitionBy(*family)
    # fullness only ends once along the order: a child is used up if it and all before it are
    rows = rows.withColumn("__full", F.min("__full").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumns({
        "__rest": F.greatest(F.col("budget") - F.coalesce(F.sum(F.when(F.col("__full"), F.col("capacity"))).over(family_of), F.lit(0)), F.lit(0)),
        "__share": F.coalesce(F.sum(F.when(~F.col("__full"), F.col("weight"))).over(family_of), F.lit(0)),
        "__upto": F.coalesce(F.sum(F.when(~F.col("__full"), F.col("weight"))).over(family_of.orderBy(F.col(name).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)),
    })
    dealt = lambda upto: F.expr(f"(cast(__rest as {_WIDE}) * ({upto})) div __share")
    target = F.when(F.col("__full"), F.col("capacity")).otherwise(dealt("__upto") - dealt("__upto - weight")).cast("long")
    return rows.withColumn("target", target).drop("__used", "__weights", "__full", "__rest", "__share", "__upto")


def budgets(leaves: DataFrame, weights, budget: Column, epochs: int, levels=LEVELS) -> DataFrame:
    """Leaves (``levels``, tokens) with their target, from the root's budget downwards.

    One row for each leaf: as many as there are sources, not documents.
    """
    root, levels = "__root", list(levels)
    rows = leaves.withColumns({root: F.lit(0), "capacity": F.col("tokens") * epochs})
    tree = rows.groupBy(root).agg(F.sum("tokens").alias("tokens")).select(root, budget.cast("long").alias("target"))
    family = [root]
    for level in levels:
        own = [*family, level]
        children = rows.groupBy(*own).agg(F.sum("capacity").alias("capacity"), F.sum("tokens").alias("tokens"))
        children = children.withColumn("weight", _weight(weights, [F.col(c) for c in own[1:]]))
        up = tree.select(*[F.col(c).alias(f"__up_{c}") for c in family], F.col("target").alias("budget"))
        children = children.join(up, [F.col(c).eqNullSafe(F.col(f"__up_{c}")) for c in family]).drop(*[f"__up_{c}" for c in family])
        tree = shared_out(children, family, level).drop("budget")
        family = own
    return tree.drop(root)


def mix(
    documents: DataFrame, weights=WEIGHTS, share: float = 0.5, epochs: int = 4, seed: int = SEED, bucket_rows: int = 20_000,
    doc: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", row: str | None = None,
) -> DataFrame:
    """The mixture: ``doc``, domain, lang, source, epoch, start, n_tokens, take.

    The whole budget is ``share`` (in millionths) of all tokens; a token is a word ``[^\\x20\\x09-\\x0D]+``.
    A leaf takes its documents once for each whole epoch (0, 1, ...), up to ``epochs``, and of one more
    epoch those whose running total, in the order of md5(seed:epoch:id), starts below what is left: ``start``
    is that total (null in whole epochs), ``take`` the tokens taken, fewer than n_tokens for the last document.

    Null texts and texts without words have no tokens and are not chosen. Null languages and sources are
    names of their own. A null id takes the place of an empty one; rows of equal order are taken by n_tokens,
    then as they come. A column named by ``row`` is handed through, so that rows can be found again. Repeated rows are documents of their own. An empty table gives no rows. Other
    columns are not read.

    A leaf's order is cut into ranges of the hash, about ``bucket_rows`` rows each by the leaf's count; running
    totals run inside a range and over the ranges' totals, so that a leaf of any size spreads over many tasks.
    """
    keys, also = list(LEVELS), [row] if row else []
    rows = common.written(documents.select(
        F.col(doc).alias("id"), domain_of(F.col(source)).alias("domain"), F.col(lang).alias("lang"), F.col(source).alias("source"), words_in(F.col(text)).alias("n"), *also,
    ).where("n > 0"), "tokens")
    leaves = rows.groupBy(*keys).agg(F.sum("n").alias("tokens"), F.count("*").alias("docs"))
    total = F.expr(f"cast(cast(tokens as {_WIDE}) * {round(share * 1_000_000)} div 1000000 as long)")
    plan = budgets(leaves.select(*keys, "tokens"), weights, total, epochs).select(*[F.col(c).alias(f"__{c}") for c in keys], "target")
    plan = common.written(
        leaves.join(plan, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keys])
        .select(*[F.col(c).alias(f"__{c}") for c in keys], F.expr("target div tokens").alias("whole"), F.expr("target % tokens").alias("rest"), F.expr(f"docs div {bucket_rows} + 1").alias("buckets")),
        "budgets",
    )
    same_leaf = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keys]
    with_plan = rows.join(plan, same_leaf).drop(*[f"__{c}" for c in keys])
    whole = with_plan.where("whole > 0").select(
        "id", *also, *keys, F.explode(F.sequence(F.lit(0), F.col("whole").cast("int") - 1)).alias("epoch"), F.lit(None).cast("long").alias("start"), "n", F.col("n").alias("take")
    )
    mark = F.md5(F.concat_ws(":", F.lit(seed), F.col("whole"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"))
    part = with_plan.where("rest > 0").withColumn("mark", mark)
    # 28 bits of the hash, scaled to the leaf's number of ranges: ranges keep the order
    part = part.withColumn("bucket", F.expr("cast(conv(substr(mark, 1, 7), 16, 10) as long) * buckets div 268435456"))
    sums = part.groupBy(*keys, "bucket").agg(F.sum("n").alias("sum"))
    before = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("base", F.coalesce(F.sum("sum").over(before), F.lit(0))).select(*[F.col(c).alias(f"__{c}") for c in keys], F.col("bucket").alias("__bucket"), "base")
    part = part.join(sums, [*same_leaf, F.col("bucket") == F.col("__bucket")]).where("base < rest")
    inside = Window.partitionBy(*keys, "bucket").orderBy("mark", "n").rowsBetween(Window.unboundedPreceding, -1)
    part = part.withColumn("start", F.col("base") + F.coalesce(F.sum("n").over(inside), F.lit(0))).where("start < rest")
    part = part.select("id", *also, *keys, F.col("whole").cast("int").alias("epoch"), "start", "n", F.least("n", F.col("rest") - F.col("start")).alias("take"))
    return whole.unionByName(part).select(F.col("id").alias(doc), *keys, "epoch", "start", F.col("n").alias("n_tokens"), "take", *also)


def query(spark, sf_dir):
    return mix(common.table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source"))


def _case(names: tuple, depth: int) -> str:
    return " AND ".join(f"{level} = '{name}'" for level, name in zip(LEVELS, names))


def _level(depth: int) -> str:
    own, family = LEVELS[: depth + 1], LEVELS[:depth]
    cases = " ".join(f"WHEN {_case(n, depth)} THEN {w}" for n, w in WEIGHTS.items() if len(n) == depth + 1)
    weight = f"CASE {cases} ELSE 1 END" if cases else "1"
    part = f"PARTITION BY {', '.join(family)}" if family else ""
    keys = ", ".join(own)
    budget = "(SELECT total FROM root)" if not family else "target"
    join = f"JOIN (SELECT {', '.join(f'{c} AS u_{c}' for c in family)}, target FROM t{depth - 1}) ON {' AND '.join(f'{c} IS NOT DISTINCT FROM u_{c}' for c in family)}" if family else ""
    # the level of a family is the largest budget per weight at which nothing is lost: found by testing each child's ratio
    return f"""
c{depth} AS (SELECT {keys}, CAST(sum(tokens) * 4 AS HUGEINT) AS cap, CAST({weight} AS HUGEINT) AS w FROM leaf GROUP BY {keys}),
b{depth} AS (SELECT c.*, CAST({budget} AS HUGEINT) AS budget FROM c{depth} c {join}),
f{depth} AS (SELECT *, budget * w >= cap * sum(w) OVER (x RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) + w * coalesce(sum(cap) OVER (x RANGE UNBOUNDED PRECEDING EXCLUDE GROUP), 0) AS used_up
  FROM b{depth} WINDOW x AS ({part} ORDER BY CAST(cap AS DOUBLE) / CAST(w AS DOUBLE))),
r{depth} AS (SELECT *, budget - coalesce(sum(cap) FILTER (WHERE used_up) OVER ({part}), 0) AS rest, sum(w) FILTER (WHERE NOT used_up) OVER ({part}) AS ws,
  sum(w) FILTER (WHERE NOT used_up) OVER ({part} ORDER BY {LEVELS[depth]} NULLS FIRST) AS upto FROM f{depth}),
t{depth} AS (SELECT {keys}, CASE WHEN used_up THEN cap ELSE CAST(rest * upto // ws - rest * (upto - w) // ws AS HUGEINT) END AS target FROM r{depth})"""


SQL = rf"""
WITH d AS (
  SELECT doc_id, CASE WHEN source = 'src0' THEN 'crawl' WHEN regexp_full_match(source, 'src[1-9]') THEN 'books' ELSE 'forums' END AS domain, lang, source,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n
  FROM documents
), leaf AS (SELECT domain, lang, source, sum(n) AS tokens FROM d WHERE n > 0 GROUP BY ALL),
root AS (SELECT coalesce(sum(tokens), 0) * 500000 // 1000000 AS total FROM leaf),{",".join(_level(k) for k in range(3))},
p AS (
  SELECT d.*, target // tokens AS whole, target % tokens AS rest
  FROM d JOIN leaf l ON d.domain = l.domain AND d.lang IS NOT DISTINCT FROM l.lang AND d.source IS NOT DISTINCT FROM l.source
  JOIN t2 t ON d.domain = t.domain AND d.lang IS NOT DISTINCT FROM t.lang AND d.source IS NOT DISTINCT FROM t.source WHERE n > 0
), q AS (
  SELECT *, coalesce(sum(n) OVER (PARTITION BY domain, lang, source ORDER BY md5('{SEED}:' || whole || ':' || doc_id), n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM p
)
SELECT doc_id, domain, lang, source, CAST(e AS INTEGER) AS epoch, CAST(NULL AS BIGINT) AS start, CAST(n AS BIGINT) AS n_tokens, CAST(n AS BIGINT) AS take
FROM (SELECT *, unnest(generate_series(0, CAST(whole AS BIGINT) - 1)) AS e FROM p WHERE whole > 0)
UNION ALL
SELECT doc_id, domain, lang, source, CAST(whole AS INTEGER), CAST(start AS BIGINT), CAST(n AS BIGINT), CAST(least(n, rest - start) AS BIGINT) FROM q WHERE rest > 0 AND start < rest
"""
