"""N-gram Jaccard join by a token-group matrix.

Documents become sets of word shingles, equal sets one class. Similar classes are put together in groups of
bounded size and compared inside. A group keeps the union of its members' tokens, as rows of a token-group
matrix; the overlap of a class with a group is bounded by the tokens they share, and only groups that may
hold a partner are opened.

Of a set of n tokens in one global order, the first n - need + k (need: the least overlap of a partner) hold
k that a partner has among its own first ones. So the rows of the matrix, and the bound, need these alone. With
the sizes of both sets the overlap is known better: ``within`` tells which places still count for such a pair.
"""

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common
from .graph import components

#: group size that a task compares in full, number of frequent tokens that are ordered last, first tokens that partners share
GROUP, FREQUENT, SHARED = 256, 65_536, 8
#: the same for two classes, where fewer places make fewer rows
PAIRED = 2
_COLD = 1 << 62
#: tokens that a task counts at a time, and counts that it keeps in between
COUNTED, KEPT = 1 << 21, 1 << 20
#: most bytes of the filter of tokens that two classes hold; it is sent to every task, and beyond them lets more tokens through
FILTER = 1 << 24
#: classes, of 8 bytes, that are sent to every task to choose their texts; more are joined by a shuffle
SENT = 500_000


def set_of(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    return np.unique(common.shingles(common.word_hashes(text), width))


def class_of(tokens: np.ndarray) -> int:
    """A 64-bit name of a set."""
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def need(n, percent: int):
    """Least number of its n tokens that a set shares with any partner."""
    return -(-n * percent // 100)


def linked(common_size, n, m, percent: int):
    return 100 * common_size >= percent * (n + m - common_size)


def within(n: str, place: str, m: str, percent: int, shared: int = SHARED) -> str:
    """SQL: whether the token at ``place`` of a set of ``n`` is among the first that count against a partner of ``m`` tokens.

    These are n - overlap + shared, with the least overlap percent * (n + m) / (100 + percent). ``m`` may be a lower bound.
    """
    return f"{percent} * {m} <= 100 * {n} - {100 + percent} * ({place} - {shared - 1})"


class Counts:
    """How often tokens occur, in bounded memory: tokens met once in a whole batch, or seldom where too many are kept, are forgotten."""

    def __init__(self):
        self.tokens, self.counts = np.empty(0, np.int64), np.empty(0, np.int64)
        self.waiting: list[np.ndarray] = []
        self.size = 0

    def add(self, tokens: np.ndarray) -> None:
        self.waiting.append(tokens)
        self.size += len(tokens)
        if self.size >= COUNTED:
            self.settle()

    def settle(self):
        if self.waiting:
            met = np.concatenate(self.waiting)
            self.waiting, self.size = [], 0
            met.sort()
            edge = np.flatnonzero(np.diff(np.concatenate(([False], met[1:] == met[:-1], [False])).view(np.int8)))
            tokens, at = np.unique(np.concatenate((self.tokens, met[edge[::2]])), return_inverse=True)
            counts = np.bincount(at, weights=np.concatenate((self.counts, edge[1::2] - edge[::2] + 1)), minlength=len(tokens)).astype(np.int64)
            if len(tokens) > KEPT:
                keep = np.sort(np.argpartition(counts, -KEPT)[-KEPT:])
                tokens, counts = tokens[keep], counts[keep]
            self.tokens, self.counts = tokens, counts
        return self.tokens, self.counts


def first_tokens(tokens: np.ndarray, order, percent: int) -> np.ndarray:
    """Ranks of the tokens that stand first in the global order: rare ones by hash, then the frequent ones, most frequent last.

    ``order``: the frequent tokens' ranks by hash alone, sorted, and the place of each among them.
    """
    names, place = order
    ranks = (tokens >> np.uint64(2)).astype(np.int64)
    if len(names):
        at = np.minimum(np.searchsorted(names, ranks), len(names) - 1)
        hot = names[at] == ranks
        ranks[hot] = _COLD + place[at[hot]]
    ranks.sort()
    least = need(len(tokens), percent)
    return ranks[: len(tokens) - least + min(SHARED, least)]


def _classes(documents: DataFrame, width: int) -> DataFrame:
    """(d, cls, n, t, tok, c): a row for each document with its class and set size, and a text of each class once a task; rows (tok, c) for tokens frequent within one task."""
    kind = documents.schema["d"].dataType.simpleString()

    def run(batches):
        seen, often = set(), Counts()
        names = ["d", "cls", "n", "t", "tok", "c"]
        for batch in batches:
            texts = batch.column(1).to_pylist()
            sets = [set_of(t, width) for t in texts]
            classes = [class_of(s) for s in sets]
            for k, (own, cls) in enumerate(zip(sets, classes)):
                if len(own) and cls not in seen:
                    seen.add(cls)
                    often.add((own >> np.uint64(2)).astype(np.int64))
                else:
                    texts[k] = None
            n = len(sets)
            kind_of = batch.column(0).type
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(classes, pa.int64()), pa.array(map(len, sets), pa.int64()), pa.array(texts, pa.string()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names
            )
        if seen:
            tokens, count = often.settle()
            tokens, count = tokens[count > 2], count[count > 2]
            k = len(tokens)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(k, kind_of), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.string()), pa.array(tokens, pa.int64()), pa.array(count, pa.int64())], names
            )
        common.give_back()

    return documents.mapInArrow(run, f"d {kind}, cls long, n long, t string, tok long, c long")


def _firsts(texts: DataFrame, width: int, percent: int, order, repeated=None) -> DataFrame:
    """First tokens of each class of (cls, t), once a task: (r) alone, or (r, cls, n, place) of those that the filter ``repeated`` may hold."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            out: list[tuple] = []
            for cls, text in zip(*(c.to_pylist() for c in batch.columns)):
                if cls in seen:
                    continue
                seen.add(cls)
                tokens = set_of(text, width)
                r = first_tokens(tokens, order.value, percent)
                if repeated is None:
                    out.append((r,))
                    continue
                place = np.flatnonzero(may_hold(repeated.value, r))
                out.append((r[place], np.full(len(place), cls), np.full(len(place), len(tokens)), place))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out)], ["r", "cls", "n", "place"][: len(out[0])])
        common.give_back()

    return texts.mapInArrow(run, "r long" if repeated is None else "r long, cls long, n long, place long")


def bits_of(tokens: DataFrame) -> np.ndarray:
    """A filter of the tokens (r) that are not among the frequent ones: one bit each, 16 to a token, ``FILTER`` bytes at most. Beyond that it holds more."""
    cells = 64
    wanted = min(8 * FILTER, 16 * tokens.count())
    while cells < wanted:
        cells *= 2
    slot = F.expr(f"(r & {cells - 1}L) div 64").alias("slot")
    got = tokens.where(F.col("r") < _COLD).select(slot, F.expr("shiftleft(1L, cast(r & 63 as int))").alias("mask")).groupBy("slot").agg(F.bit_or("mask").alias("mask")).toArrow()
    bits = np.zeros(cells // 64, np.uint64)
    bits[got["slot"].to_numpy()] = got["mask"].to_numpy().view(np.uint64)
    return bits


def may_hold(bits: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Whether each token may be in the filter; frequent tokens always may."""
    place = r & (64 * len(bits) - 1)
    return (r >= _COLD) | (bits[place >> 6] >> (place & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def _compared(width: int, percent: int):
    """In-group links: every pair of the group's members, one member against all others at a time."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        sets = [set_of(t, width) for t in group["t"]]
        cls = group["cls"].to_numpy()
        size = np.array([len(s) for s in sets])
        start = np.concatenate(([0], np.cumsum(size)))[:-1]
        names, place = np.unique(np.concatenate(sets), return_inverse=True)
        label = np.arange(len(sets))
        mark = np.zeros(len(names), np.int64)
        for k in range(len(sets)):
            own = place[start[k] : start[k] + size[k]]
            mark[own] = 1
            shared = np.add.reduceat(mark[place], start)
            mark[own] = 0
            for j in np.flatnonzero(linked(shared, size[k], size, percent)):
                low, high = sorted((label[k], label[j]))
                if low != high:
                    label[label == high] = low
        least = {own: cls[label == own].min() for own in np.unique(label)}
        return pd.DataFrame({"cls": cls, "comp": [least[own] for own in label]})

    return run


def _verified(width: int, percent: int):
    def run(batches):
        for batch in batches:
            keep = []
            for one, other in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                a, b = set_of(one, width), set_of(other, width)
                keep.append(linked(len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b), percent))
            yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1])

    return run


def join(
    documents: DataFrame, width: int = 4, percent: int = 85, doc: str = "doc_id", text: str = "text", group: int = GROUP, frequent: int = FREQUENT,
) -> DataFrame:
    """``doc``, n_shingles, component_id for each row of ``documents``.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a set holds the distinct runs of ``width`` words, or
    all words as one run if there are fewer. Sets link when 100 * intersection >= percent * union; component_id
    is the smallest id reachable by links. Null and wordless texts have size 0, link with nothing and are
    their own component. Rows repeated or without an id are documents like others (a component of null ids has
    a null id). An empty table gives no rows; other columns are not read. Sets are compared by 64-bit hashes.

    No link between different sets is lost: classes of one group are all compared, and classes of different
    groups whenever they share a first token and are not yet connected. Copies cost nothing beyond their
    class. The ``frequent`` most frequent first tokens (a bound on what is sent to the tasks) are moved to the
    end of the order; that changes how many candidates there are, never the result.
    """
    spark = documents.sparkSession
    common.small_batches(spark)
    rows = documents.select(F.col(doc).alias("d"), F.col(text).alias("t"))
    found = common.written(_classes(rows, width), "classes", "zstd")
    texts = found.where("t IS NOT NULL").select("cls", "t")
    own = common.written(found.where("cls IS NOT NULL").select("d", "cls", "n"), "own")
    hot = found.where("tok IS NOT NULL").groupBy("tok").agg(F.sum("c").alias("c")).orderBy(F.col("c").desc(), "tok").limit(frequent).toArrow()
    names, counts = hot["tok"].to_numpy(), hot["c"].to_numpy()
    by_name, place = np.argsort(names), np.empty(len(names), np.int64)
    place[np.lexsort((names, counts))] = np.arange(len(names))
    shared = spark.sparkContext.broadcast((names[by_name], place[by_name]))

    # ---- groups: classes that share first tokens, around the least class of each token
    # copies in two tasks count a token twice here; the distinct rows are counted again below
    tokens = common.written(_firsts(texts, width, percent, shared).groupBy("r").agg(F.count("*").alias("k")).where("k > 1").select("r"), "tokens")
    # most first tokens are met once and leave in the task; a few that the filter cannot tell go with the exact join
    repeated = spark.sparkContext.broadcast(bits_of(tokens))
    held = common.written(_firsts(texts, width, percent, shared, repeated).join(tokens, "r").distinct(), "matrix")
    common.dropped(tokens)
    # a place counts where it does against some partner of the token; a class with fewer of them than it shares with any partner has none
    reach = F.max(F.expr(f"100 * n - {100 + percent} * (place - {SHARED - 1})")).alias("reach")
    counts = f"{percent} * n <= reach AND {within('n', 'place', f'greatest(least, (n * {percent} + 99) div 100)', percent)}"
    asked = f"least({SHARED}, (n * {percent} + 99) div 100)"
    holders = held.groupBy("r").agg(F.count("*").alias("classes"), F.min("n").alias("least"), reach).where("classes > 1")
    before, held = held, common.written(held.join(holders, "r").where(counts).select("r", "cls", "n", "place", "classes"), "matrix")
    common.dropped(before)
    score = held.groupBy("cls").agg(F.count("*").alias("k"), F.first("n").alias("n"), F.sum("classes").alias("score")).where(f"k >= {asked}").select("cls", "score")
    before, held = held, common.written(held.join(score, "cls").drop("classes"), "matrix")
    common.dropped(before)
    # the centre of a token is the class whose first tokens are the most common: of near copies, what they are copies of
    centres = held.groupBy("r").agg(F.max(F.struct("score", "cls"))["cls"].alias("centre"), F.count("*").alias("classes")).where("classes > 1").drop("classes")
    before, held = held, common.written(held.join(centres, "r").select("r", "cls", "n", "place", "centre"), "matrix")
    common.dropped(before)
    best = held.groupBy("cls", "centre").agg(F.count("*").alias("k"), F.first("n").alias("n"))
    home = best.groupBy("cls").agg(F.max(F.struct("k", "centre"))["centre"].alias("centre"), F.first("n").alias("n"))
    cuts = home.groupBy("centre").agg(F.expr(f"cast(ceil(count(*) / {group}) as int)").alias("cuts"))
    home = common.written(home.join(cuts, "centre").select("cls", "n", "centre", "cuts", F.expr("cast(pmod(xxhash64(cls), cuts) as int)").alias("part")), "groups")
    wanted = home.select("cls")
    if home.count() <= SENT:  # else both sides are dealt by class
        wanted = F.broadcast(wanted)
    sets = common.written(texts.join(wanted, "cls").dropDuplicates(["cls"]), "texts", "zstd")
    common.dropped(found)
    members = home.select("cls", "centre", "part").unionByName(
        home.groupBy("centre").agg(F.max("cuts").alias("cuts")).select(F.col("centre").alias("cls"), "centre", F.explode(F.expr("sequence(0, cuts - 1)")).alias("part"))
    ).distinct()
    inside = members.join(sets, "cls").groupBy("centre", "part").applyInPandas(_compared(width, percent), "cls long, comp long")
    inside = common.written(inside.where("cls != comp").select(F.col("cls").alias("a"), F.col("comp").alias("b")), "inside")
    # ---- the matrix: unions of the groups, bound, opened groups
    labels = components(inside)
    labels = common.written(labels.join(labels.groupBy("label").agg(F.count("*").alias("members")), "label"), "labels")
    placed = held.join(labels, held["cls"] == labels["node"], "left").select("r", "cls", "n", "place", F.coalesce("label", "cls").alias("grp"), F.coalesce("members", F.lit(1)).alias("members"))
    open_tokens = placed.groupBy("r").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi"), F.min("n").alias("least"), reach).where("lo != hi")
    placed = common.written(placed.join(open_tokens, "r").where(counts).select("r", "cls", "n", "place", "grp", "members"), "placed")
    common.dropped(held, labels)
    able = placed.groupBy("cls").agg(F.count("*").alias("k"), F.first("n").alias("n")).where(f"k >= {asked}").select("cls")
    before, placed = placed, common.written(placed.join(able, "cls").join(home.select("cls", "centre", "part"), "cls"), "placed")
    common.dropped(before)
    # of a token and a group: sizes of the members that hold it, and the largest partner for which its place counts
    unions = placed.groupBy("r", "grp").agg(
        F.first("members").alias("members"), F.min("n").alias("least"), F.max("n").alias("most"), reach
    )
    asks = placed.select("r", F.col("cls").alias("x"), F.col("n").alias("nx"), F.col("place").alias("px"), F.col("grp").alias("gx"), F.col("members").alias("mx"))
    # the bound: a class and a group with fewer shared first tokens hold no partners; sizes bound the rest. The smaller group asks the larger one
    few = lambda a, b, shared: f"least({shared}, ({percent} * ({a} + {b}) + {99 + percent}) div {100 + percent})"
    bound = asks.join(unions, "r").where(
        f"(mx < members OR (mx = members AND gx < grp)) AND least * {percent} <= nx * 100 AND most * 100 >= nx * {percent} AND {percent} * nx <= reach AND {within('nx', 'px', 'least', percent)}"
    )
    opened = bound.groupBy("x", "grp").agg(F.count("*").alias("overlap"), F.first("nx").alias("nx"), F.min("least").alias("least")).where(f"overlap >= {few('nx', 'least', SHARED)}")
    left = placed.select("r", F.col("cls").alias("x"), F.col("n").alias("nx"), F.col("place").alias("at"), F.col("centre").alias("cx"), F.col("part").alias("px")).join(opened.select("x", "grp"), "x")
    pairs = left.join(placed.select("r", F.col("cls").alias("y"), "grp", "n", "place", "centre", "part"), ["r", "grp"]).where(
        f"100 * least(n, nx) >= {percent} * greatest(n, nx) AND NOT (cx = centre AND px = part) AND y != cx AND x != centre AND {within('nx', 'at', 'n', percent, PAIRED)} AND {within('n', 'place', 'nx', percent, PAIRED)}"
    ).groupBy("x", "y").agg(F.count("*").alias("overlap"), F.first("nx").alias("nx"), F.first("n").alias("n")).where(f"overlap >= {few('nx', 'n', PAIRED)}").select("x", "y")
    pairs = pairs.join(sets.select(F.col("cls").alias("x"), F.col("t").alias("tx")), "x").join(sets.select(F.col("cls").alias("y"), F.col("t").alias("ty")), "y").select("x", "y", "tx", "ty")
    across = pairs.mapInArrow(_verified(width, percent), "x long, y long").select(F.col("x").alias("a"), F.col("y").alias("b"))
    across = common.written(across, "across")
    common.dropped(placed, home, sets)
    labels = components(inside.unionByName(across))
    # ---- documents
    named = own.join(labels, own["cls"] == labels["node"], "left").select("d", "n", F.coalesce("label", "cls").alias("label"))
    least = named.where("n > 0").groupBy("label").agg(F.min("d").alias("least"))
    return named.join(least, "label", "left").select(F.col("d").alias(doc), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("d")).alias("component_id"))


def query(spark, sf_dir):
    return join(common.table(spark, sf_dir, "documents", "doc_id", "text"))


SQL = rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{common.CAPITALS}', '{common.SMALL}'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT k, hash(array_to_string(w[i:i + 3], ' ')) AS h FROM (SELECT k, w, unnest(generate_series(1, greatest(1, len(w) - 3))) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT k, count(*) AS n FROM s GROUP BY k
), c AS (SELECT a.k AS a, b.k AS b, count(*) AS shared FROM s a JOIN s b ON a.h = b.h AND a.k < b.k GROUP BY ALL
), l AS (SELECT a, b FROM c JOIN n x ON x.k = a JOIN n y ON y.k = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)
), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), reach AS (SELECT k AS a, k AS b FROM d UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, (SELECT min(t.doc_id) FROM reach r JOIN d t ON t.k = r.b WHERE r.a = d.k) AS component_id
FROM d LEFT JOIN n USING (k)
"""
