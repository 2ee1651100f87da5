"""Secret scan by a trigram inverted index, in DataFrame operations only.

Each rule's regular expression gives a Boolean query over the trigrams that any match must hold. The
index has, for every trigram asked for and every block of document ids, the ids of the texts that hold it.
Posting lists are intersected and united as the queries say, and the rules run on the candidates alone.
A rule that demands no trigram runs on every text.
"""

from dataclasses import dataclass
from functools import reduce
from re import _parser  # the parsed form of a regular expression

from pyspark.sql import Column, DataFrame, functions as F

from . import common


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds candidates; a match counts if group ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


def _any_case(words: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


_KEYS = "|".join(map(_any_case, ("password", "passwd", "secret", "token", "api_?key")))
#: fixed patterns of the query's contract, in the order that breaks ties
RULES = (
    Rule("assign", rf"""({_KEYS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
#: the method's own spans, after those of the contract
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
)
BLOCK = 4096

# ---- Boolean trigram queries ----------------------------------------------------------------------
# A query is a set of alternatives, each a set of trigrams that must all occur; the empty alternative is
# always true. Trigrams are over lower-cased text.


def _simplified(alternatives) -> frozenset:
    found = set(alternatives)
    return frozenset(a for a in found if not any(b < a for b in found))


def _both(one: frozenset, other: frozenset) -> frozenset:
    return _simplified(a | b for a in one for b in other)


TRUE = frozenset([frozenset()])


def _held(strings) -> frozenset:
    """The query of texts that hold one of the strings."""
    return _simplified(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)


def trigram_query(pattern: str, most: int = 64) -> frozenset:
    """Alternatives of trigrams, one of which occurs in every match of the pattern."""
    query, strings = _derived(_parser.parse(pattern), most)
    return _both(query, _held(strings)) if strings is not None else query


def _derived(sequence, most):
    """(query, exact): what any match demands; the strings the whole can be, or None if they are too many.

    Strings under way are kept until something unbounded follows; then they become trigrams.
    """
    query, exact, whole = TRUE, {""}, True
    for op, argument in sequence:
        strings, extra = _piece(str(op), argument, most)
        query = _both(query, extra)
        if strings is not None and len(exact) * len(strings) <= most:
            exact = {a + b for a in exact for b in strings}
        else:
            query, exact, whole = _both(query, _held(exact)), {""}, False
            if strings is not None and len(strings) <= most:
                exact = set(strings)
    if whole:
        return query, exact
    return _both(query, _held(exact)), None


def _piece(op, argument, most):
    """(strings it can be or None, query it demands) of one element."""
    if op == "LITERAL":
        return {chr(argument).lower()}, TRUE
    if op == "IN":
        chars = set()
        for kind, value in argument:
            if str(kind) == "LITERAL":
                chars.add(chr(value).lower())
            elif str(kind) == "RANGE" and value[1] - value[0] < most:
                chars.update(chr(c).lower() for c in range(value[0], value[1] + 1))
            else:
                return None, TRUE
        return (chars if len(chars) <= 4 else None), TRUE
    if op == "SUBPATTERN":
        query, exact = _derived(argument[3], most)
        return exact, query
    if op == "BRANCH":
        parts = [_derived(branch, most) for branch in argument[1]]
        if all(exact is not None for _, exact in parts):
            return set().union(*(exact for _, exact in parts)), TRUE
        return None, _simplified(a for query, exact in parts for a in (_both(query, _held(exact)) if exact is not None else query))
    if op in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
        least, high, inner = argument
        query, exact = _derived(inner, most)
        if (least, high) == (0, 1) and exact is not None:
            return {"", *exact}, TRUE
        return None, (_both(query, _held(exact)) if exact is not None else query) if least else TRUE
    return ({""} if op == "AT" else None), TRUE


# ---- index, candidates ----------------------------------------------------------------------------


def build_index(documents: DataFrame, trigrams, doc: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """(block, trigram, ids): for every trigram and every block of ``block`` consecutive ids, the sorted ids of the texts that hold it.

    A posting list holds at most ``block`` ids, so no frequent trigram gathers more than that in one place.
    Texts without an id or text have no postings.
    """
    low = documents.where(F.col(doc).isNotNull() & F.col(text).isNotNull()).select(F.col(doc).cast("long").alias("d"), F.lower(text).alias("t"))
    held = F.array(*[F.when(F.contains("t", F.lit(g)), F.lit(g)) for g in sorted(trigrams)])
    return (
        low.select("d", F.explode(F.array_compact(held)).alias("trigram"))
        .groupBy(F.floor(F.col("d") / block).alias("block"), "trigram")
        .agg(F.sort_array(F.collect_set("d")).alias("ids"))
    )


def candidates(index: DataFrame, queries: dict[int, frozenset]) -> DataFrame:
    """(d, rules): ids whose texts satisfy a rule's query, with a bit for each rule; posting lists meet block by block."""
    lists = F.map_from_entries(F.collect_list(F.struct("trigram", "ids")))
    none = F.array().cast("array<bigint>")

    def answer(query):
        parts = [reduce(F.array_intersect, [F.coalesce(F.col("lists")[g], none) for g in sorted(alternative)]) for alternative in sorted(query, key=sorted)]
        return reduce(F.array_union, parts)

    blocks = index.groupBy("block").agg(lists.alias("lists"))
    found = F.array(*[F.struct(F.lit(1 << k).alias("bit"), answer(q).alias("ids")) for k, q in sorted(queries.items())])
    rows = blocks.select(F.explode(found).alias("f")).select("f.bit", F.explode("f.ids").alias("d"))
    return rows.groupBy("d").agg(F.bit_or("bit").alias("rules"))


# ---- verification ---------------------------------------------------------------------------------


def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """Matches of the rule as (start, order, end, kind), leftmost and not overlapping, code points from 0, end exclusive.

    The text between matches and the matches alternate, so that their lengths give every start.
    """
    java = _of_length(rule)
    matches, between = F.regexp_extract_all(text, F.lit(java), F.lit(0)), F.split(text, java, -1)
    judged = F.regexp_extract_all(text, F.lit(java), F.lit(rule.group)) if rule.group else matches
    pieces = F.arrays_zip(
        F.transform(between, F.char_length).alias("gap"), F.transform(matches, F.char_length).alias("size"), F.transform(judged, F.char_length).alias("held")
    )
    item = "array<struct<start:int,ord:int,end:int,kind:string>>"

    def step(state, piece):
        start = state["at"] + piece["gap"]
        end = start + F.coalesce(piece["size"], F.lit(0))
        span = F.struct(start.alias("start"), F.lit(order).alias("ord"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        kept = F.when(piece["held"] >= rule.least, F.array(span)).otherwise(F.array().cast(item))
        return F.struct(end.alias("at"), F.concat(state["out"], kept).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast(item).alias("out"))
    return F.when(F.size(matches) > 0, F.aggregate(pieces, zero, step, lambda s: s["out"])).otherwise(F.array().cast(item))


def scan(documents: DataFrame, rules=RULES + MORE, doc: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """``doc`` and ``found``, the spans of all rules by start and then rule, for each row of ``documents``.

    Only texts that the index names are read by a rule with a trigram query; rules without one read all.
    Null texts count as empty; a row without an id is not in the index, so all rules read it. Repeated rows
    stay, an empty table gives none; other columns are not read. Documents are shuffled once, by id, to meet
    their candidates (broadcast by Spark while few); the index and the candidates hold ids only.
    """
    rules = tuple(rules)
    asked = {k: q for k, rule in enumerate(rules) if (q := trigram_query(rule.pattern)) != TRUE}
    rows = documents.select(F.col(doc).alias("d"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    if asked:
        trigrams = {g for q in asked.values() for alternative in q for g in alternative}
        named = candidates(build_index(documents, trigrams, doc, text, block), asked).withColumnRenamed("d", "id")
        rows = rows.join(named, F.col("d").cast("long") == F.col("id"), "left").drop("id")
    else:
        rows = rows.withColumn("rules", F.lit(0))
    item = F.array().cast("array<struct<start:int,ord:int,end:int,kind:string>>")

    def of(k, rule):
        spans = spans_of(F.col("t"), rule, k)
        if k not in asked:
            return F.when(F.col("t").rlike(_of_length(rule)), spans).otherwise(item)
        return F.when(F.col("d").isNull() | (F.coalesce(F.col("rules"), F.lit(0)).bitwiseAND(1 << k) != 0), spans).otherwise(item)

    return rows.select(F.col("d").alias(doc), F.array_sort(F.concat(*[of(k, r) for k, r in enumerate(rules)])).alias("found"))


def _of_length(rule: Rule) -> str:
    """The pattern; for one class repeated, its runs of ``least`` and more at once, which are the matches that count."""
    alone = rule.pattern.startswith("[") and rule.pattern.endswith("]+") and rule.pattern.count("[") == 1
    return rule.pattern[:-1] + "{%d,}" % rule.least if alone else rule.pattern


def _joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def query(spark, sf_dir):
    found = scan(common.table(spark, sf_dir, "documents", "doc_id", "text"))
    base = F.filter("found", lambda x: x["ord"] < len(RULES))
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[count(r.kind) for r in RULES], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans")
    )


def _sql() -> str:
    def own(k, rule):
        pattern = _of_length(rule).replace("'", "''")
        return f"""
  SELECT n, {k} AS ord, '{rule.kind}' AS kind,
    list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS start,
    length(hits[i]) AS size, length(held[i]) AS held, {rule.least} AS least
  FROM (
    SELECT n, string_split_regex(t, '{pattern}') AS gaps, regexp_extract_all(t, '{pattern}', 0) AS hits,
      regexp_extract_all(t, '{pattern}', {rule.group}) AS held,
      unnest(generate_series(1, len(regexp_extract_all(t, '{pattern}', 0)))) AS i
    FROM d WHERE regexp_matches(t, '{pattern}')
  )"""

    rules = RULES + MORE
    text = "kind || ':' || start || ':' || (start + size)"
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in RULES)
    zero = ", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in RULES)
    return f"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS t FROM documents
), s AS (SELECT n, ord, kind, CAST(start AS BIGINT) AS start, size FROM ({" UNION ALL ".join(own(k, r) for k, r in enumerate(rules))}) WHERE held >= least
), g AS (
  SELECT n, {counts}, string_agg({text}, ',' ORDER BY start, ord) FILTER (WHERE ord < {len(RULES)}) AS base, string_agg({text}, ',' ORDER BY start, ord) AS spans
  FROM s GROUP BY n
)
SELECT doc_id, {zero}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (n)
"""


SQL = _sql()
