"""Benchmark decontamination: Wu-Manber multi-pattern search over word sequences.

Patterns are the windows of benchmark items, the alphabet is words. A shift table over blocks of two words
says how far the search may skip; at shift 0 the block at the window's end picks a bucket of patterns,
the first word narrows it, and direct comparison confirms.
"""

import hashlib
import uuid
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common

WINDOW = 13
#: A-Z become a-z; bytes below 0x80 that are neither digits nor letters separate words
_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


class WuManber:
    """Patterns of one length, as tuples of words, each with the items it belongs to."""

    def __init__(self, length: int, patterns: dict[tuple, list[int]]):
        self.length, self.block = length, min(2, length)
        self.far = length - self.block + 1
        self.shift: dict[tuple, int] = {}
        self.buckets: dict[tuple, dict[bytes, list]] = defaultdict(lambda: defaultdict(list))
        for pattern, items in patterns.items():
            for end in range(self.block, length + 1):
                block = pattern[end - self.block : end]
                self.shift[block] = min(self.shift.get(block, self.far), length - end)
            self.buckets[pattern[-self.block:]][pattern[0]].append((list(pattern), items))
        self.buckets = {k: dict(v) for k, v in self.buckets.items()}

    def find(self, words: list[bytes]):
        """(start, items) of every occurrence."""
        shift, far, length, block, at, n = self.shift.get, self.far, self.length, self.block, self.length, len(words)
        while at <= n:
            step = shift(tuple(words[at - block : at]), far)
            if step == 0:
                start = at - length
                for pattern, items in self.buckets.get(tuple(words[at - block : at]), {}).get(words[start], ()):
                    if words[start:at] == pattern:
                        yield start, items
                step = 1
            at += step


def machines(items: list[tuple[int, str]], window: int = WINDOW) -> list[WuManber]:
    """One search per pattern length: ``window`` words, or all of an item that has fewer."""
    patterns: dict[int, dict[tuple, list[int]]] = defaultdict(lambda: defaultdict(list))
    for item, text in items:
        words = words_of(text)
        for start in range(max(1, len(words) - window + 1) if words else 0):
            own = tuple(words[start : start + window])
            if item not in patterns[len(own)][own]:
                patterns[len(own)][own].append(item)
    return [WuManber(length, found) for length, found in sorted(patterns.items())]


def blocks_of(benchmark: DataFrame, item: str, text: str, limit: int):
    """The benchmark in blocks of at most ``limit`` bytes of text (one item at least), whatever its size."""
    block, size = [], 0
    for row in benchmark.select(F.col(item).alias("i"), F.col(text).alias("t")).where("t IS NOT NULL").toLocalIterator():
        if block and size + len(row.t) * 4 > limit:
            yield block
            block, size = [], 0
        block.append((row.i, row.t))
        size += len(row.t) * 4
    if block:
        yield block


def contamination(
    documents: DataFrame, benchmark: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text", window: int = WINDOW, share: int = 20, block_bytes: int = 64 << 20,
) -> DataFrame:
    """``doc``, n_words, n_hit, n_items, items_sha256, contaminated, and ``items``, one row for each row of ``documents``.

    Words are runs of digits, letters and characters from U+0080 on, A-Z lower-cased. A window is ``window``
    words of an item in a row, or a whole shorter item. ``contaminated``: n_hit > 0 and share * n_hit >= n_words.
    Null and empty texts have no words; null and wordless items have no window; repeated items count once per
    id, items without an id are not counted. Repeated documents stay; empty tables give no rows or no hits.
    Other columns are not read, so none can clash.

    Whole texts are searched where they lie: no shuffle. A benchmark of up to ``block_bytes`` goes to the tasks
    in one piece; a larger one goes in several, each searched in a pass of its own, with hits and items joined
    up per row.
    """
    spark = documents.sparkSession
    common.small_batches(spark)
    rows = documents.select(F.col(doc).alias("d"), F.col(text).alias("t"))
    kind = rows.schema["d"].dataType.simpleString()
    items_kind = benchmark.schema[item].dataType.simpleString()
    rows = rows.select("d", "t", F.lit(None).cast("array<struct<s:int,e:int>>").alias("spans"), F.array().cast(f"array<{items_kind}>").alias("items"))
    schema = rows.schema.simpleString()[7:-1]
    for block in blocks_of(benchmark, item, item_text, block_bytes):
        shared = spark.sparkContext.broadcast((uuid.uuid4().hex, block))
        rows = rows.mapInArrow(_pass(shared, window, rows.schema), schema)
    out = rows.mapInArrow(_count(share), f"d {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<{items_kind}>")
    return out.withColumnRenamed("d", doc)


def keep_clean(documents: DataFrame, benchmark: DataFrame, text: str = "text", **how) -> DataFrame:
    """The rows of ``documents`` that are not contaminated, all columns as they were. No shuffle."""
    whole = documents.select(F.struct("*").alias("whole"), F.col(text).alias("t"))
    return contamination(whole, benchmark, doc="whole", text="t", **how).where("NOT contaminated").select("whole.*")


_built: dict = {}


def _machines_of(shared, window):
    """Built once for each worker and block; the last one is kept."""
    name, block = shared.value
    if name not in _built:
        _built.clear()
        _built[name] = machines(block, window)
    return _built[name]


def _pass(shared, window, schema):
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches):
        found = _machines_of(shared, window)
        for batch in batches:
            spans, items = [], []
            for text, old_spans, old_items in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                words, hits, own = words_of(text), [], set(old_items)
                for machine in found:
                    for start, which in machine.find(words):
                        hits.append((start, start + machine.length))
                        own.update(w for w in which if w is not None)
                spans.append([{"s": s, "e": e} for s, e in _merged([(x["s"], x["e"]) for x in old_spans or ()] + hits)])
                items.append(sorted(own))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, arrow.field(2).type), pa.array(items, arrow.field(3).type)], ["d", "t", "spans", "items"])

    return run


def _merged(spans):
    out = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _count(share):
    def run(batches):
        for batch in batches:
            n = [len(words_of(t)) for t in batch.column(1).to_pylist()]
            hit = [sum(x["e"] - x["s"] for x in own or ()) for own in batch.column(2).to_pylist()]
            items = [sorted(map(str, own)) for own in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array(map(len, items), pa.int64()),
                    pa.array([hashlib.sha256(",".join(own).encode()).hexdigest() for own in items]),
                    pa.array([h > 0 and share * h >= w for h, w in zip(hit, n)]), batch.column(3),
                ],
                ["d", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items"],
            )

    return run


def query(spark, sf_dir):
    return contamination(common.table(spark, sf_dir, "documents", "doc_id", "text"), common.table(spark, sf_dir, "benchmark", "item_id", "text")).drop("items")


SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS n, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{common.CAPITALS}', '{common.SMALL}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{common.CAPITALS}', '{common.SMALL}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS k, array_to_string(w[i:i + 12], ' ') AS win
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 12))) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT k FROM bw
), dw AS (
  SELECT n, i, k, array_to_string(w[i:i + k - 1], ' ') AS win
  FROM (SELECT n, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d CROSS JOIN sizes WHERE len(w) >= k)
), occ AS (SELECT n, i, dw.k, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.k = bw.k
), hit AS (SELECT n, count(DISTINCT p) AS n_hit FROM (SELECT n, unnest(generate_series(i, i + k - 1)) AS p FROM occ) GROUP BY n
), it AS (SELECT n, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT n, CAST(item_id AS VARCHAR) AS s FROM occ WHERE item_id IS NOT NULL) GROUP BY n)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (n) LEFT JOIN it USING (n)
"""
