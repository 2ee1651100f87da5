"""Spelling variants: words one edit apart, found by probing edits against Bloom filters.

Every word's deletions and replacements are made in tasks and probed against blocked Bloom filters of the vocabulary, one
for each word length, which all executors hold. (Insertions are deletions seen from the longer word.) Only
positives are shuffled, to an exact join with the vocabulary that removes the false ones.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
#: bits of a block, and places of a word in it
_BLOCK, _PLACES = 512, 7


def vocabulary(
    documents: DataFrame, least_length: int = 5, least_count: int = 3, every: int = 97, doc: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(word, n): words of at least ``least_length`` code points that occur at least ``least_count`` times.

    Words are runs of letters with A-Z lower-cased. Where ``every`` divides the crc32 of ``<doc_id>:<run>``, the
    code point at that crc32 modulo the run's length is left out. Null texts have no words; a null id is an empty one.
    """
    h, run = F.col("h"), F.col("run")
    place = (h % F.length(run)).cast("int")
    runs = documents.select(
        F.coalesce(F.col(doc).cast("string"), F.lit("")).alias("d"), F.explode(F.regexp_extract_all(F.col(text), F.lit(RUN), F.lit(0))).alias("run")
    ).where(F.length("run") >= least_length).withColumn("run", F.translate("run", common.CAPITALS, common.SMALL))
    hashed = runs.withColumn("h", F.crc32(F.encode(F.concat("d", F.lit(":"), "run"), "UTF-8")))
    words = hashed.select(
        F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), place), F.substring(run, place + 2, F.length(run)))).otherwise(run).alias("word")
    ).where(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


# ---- hashing -------------------------------------------------------------------------------------
# A word's hash is the exclusive or of a number for each (place, letter), so an edit changes it by few of them.


def _numbers(length: int) -> np.ndarray:
    """[place, letter]: the number of each letter at each place."""
    with np.errstate(over="ignore"):
        return common.mixed(np.arange(length * 256, dtype=np.uint64)).reshape(length, 256)


def hashes(letters: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Hash of each row of [word, place]: letters."""
    return np.bitwise_xor.reduce(numbers[np.arange(letters.shape[1]), letters], axis=1) if letters.shape[1] else np.zeros(len(letters), np.uint64)


def deletions(letters: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """[word, place]: hash of the word without the letter at that place."""
    count, length = letters.shape
    at = np.arange(length)
    stay, moved = numbers[at, letters], numbers[at - 1, letters]
    zero = np.zeros((count, 1), np.uint64)
    before = np.concatenate((zero, np.bitwise_xor.accumulate(stay[:, :-1], axis=1)), axis=1)
    after = np.concatenate((np.bitwise_xor.accumulate(moved[:, :0:-1], axis=1)[:, ::-1], zero), axis=1)
    return before ^ after


class Filters:
    """One blocked Bloom filter for each length of word, in one array of blocks."""

    def __init__(self, counts: dict[int, int], bits: int, most_bytes: int):
        """``counts``: words of each length. ``bits`` a word, fewer if all filters would take over ``most_bytes``."""
        words = max(1, sum(counts.values()))
        bits = min(bits, 8 * most_bytes / words)
        self.base, self.size, total = {}, {}, 0
        for length, count in sorted(counts.items()):
            self.base[length], self.size[length] = total, max(1, int(count * bits) // _BLOCK)
            total += self.size[length]
        self.blocks = np.zeros((total, _BLOCK // 64), np.uint64)

    def _block(self, h: np.ndarray, length: int) -> np.ndarray:
        return self.base[length] + (h % np.uint64(self.size[length])).astype(np.int64)

    @staticmethod
    def _places(h: np.ndarray) -> np.ndarray:
        """[hash, k]: bits of the block."""
        return (common.mixed(h)[:, None] >> np.arange(0, 9 * _PLACES, 9, dtype=np.uint64)) & np.uint64(_BLOCK - 1)

    def bits(self, h: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(number of a 64-bit word of the array, mask) of each bit to set."""
        place = self._places(h)
        slot = self._block(h, length)[:, None] * (_BLOCK // 64) + (place >> np.uint64(6)).astype(np.int64)
        return slot.ravel(), (np.uint64(1) << (place & np.uint64(63))).ravel()

    def hits(self, h: np.ndarray, length: int) -> np.ndarray:
        """Places in ``h`` of the hashes that may be in the filter."""
        if length not in self.base:
            return np.empty(0, np.int64)
        at, place, blocks = np.arange(len(h)), self._places(h), self._block(h, length)
        for k in range(_PLACES):
            bit = place[at, k]
            word = self.blocks[blocks[at], (bit >> np.uint64(6)).astype(np.int64)]
            at = at[(word >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)]
        return at


def by_length(words: list[str], cells: int):
    """(length, places in ``words``, letters) in blocks of at most ``cells`` letters, or one word."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for length in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == length)
        step = max(1, cells // length)
        for low in range(0, len(at), step):
            own = at[low : low + step]
            raw = "".join([words[i] for i in own]).encode("latin-1")
            yield length, own, np.frombuffer(raw, np.uint8).reshape(-1, length)


def build_filters(words: DataFrame, bits: int, most_bytes: int) -> Filters:
    """Filters of (word): tasks set bits, a grouping joins them, the driver holds at most ``most_bytes`` of them."""
    counts = {r.length: r["count"] for r in words.groupBy(F.length("word").alias("length")).count().collect()}
    filters = Filters(counts, bits, most_bytes)
    plain = Filters(counts, bits, most_bytes)

    def run(batches):
        for batch in batches:
            for length, _, letters in by_length(batch.column(0).to_pylist(), 1 << 18):
                slot, mask = plain.bits(hashes(letters, _numbers(length)), length)
                yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(mask.view(np.int64))], ["slot", "mask"])

    joined = words.select("word").mapInArrow(run, "slot long, mask long").groupBy("slot").agg(F.bit_or("mask").alias("mask"))
    got = joined.toArrow()
    flat = filters.blocks.reshape(-1)
    flat[got.column("slot").to_numpy()] = got.column("mask").to_numpy().view(np.uint64)
    return filters


def candidates(words: DataFrame, filters: Filters, letters_used: str, cells: int = 1 << 20) -> DataFrame:
    """(word, n, other): edits of each (word, n) that may be in the vocabulary.

    Deletions, and replacements by a greater letter, so that each pair of words is met from one side.
    """
    shared = words.sparkSession.sparkContext.broadcast(filters)
    alphabet = np.frombuffer("".join(sorted(letters_used)).encode("latin-1"), np.uint8)

    def run(batches):
        held = shared.value
        for batch in batches:
            own, counts = batch.column(0).to_pylist(), batch.column(1)
            for length, at, letters in by_length(own, max(1, cells // max(1, len(alphabet)))):
                numbers = _numbers(length)
                found, other = [], []
                flat = deletions(letters, numbers).ravel()
                for hit in held.hits(flat, length - 1).tolist():
                    word, place = divmod(hit, length)
                    text = own[at[word]]
                    # a letter in a row of equal ones: the same word for each, made once
                    if place == 0 or text[place] != text[place - 1]:
                        found.append(at[word])
                        other.append(text[:place] + text[place + 1 :])
                whole = hashes(letters, numbers)
                for low in range(0, length, max(1, cells // (len(letters) * max(1, len(alphabet))))):
                    places = np.arange(low, min(length, low + max(1, cells // (len(letters) * max(1, len(alphabet))))))
                    part = letters[:, places]
                    edit = (whole[:, None] ^ numbers[places, part])[:, :, None] ^ numbers[places][:, alphabet][None]
                    keep = np.flatnonzero((alphabet[None, None] > part[:, :, None]).ravel())
                    for hit in keep[held.hits(edit.ravel()[keep], length)].tolist():
                        rest, letter = divmod(hit, len(alphabet))
                        word, place = divmod(rest, len(places))
                        text = own[at[word]]
                        found.append(at[word])
                        other.append(text[: low + place] + chr(alphabet[letter]) + text[low + place + 1 :])
                rows = pa.array(np.array(found, np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), counts.take(rows), pa.array(other, pa.string())], ["word", "n", "other"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, other string")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): the last word that forms lead to.

    Each round replaces every word's target by its target's target, so the rounds are the logarithm of the longest
    chain; a form occurs twice as often as its word, so that there is no circle and no long chain.
    """
    now = common.written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = common.written(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = step.select("word", "root")
        if step.where("moved").isEmpty():
            return now


def group(
    documents: DataFrame, least_length: int = 5, least_count: int = 3, every: int = 97, factor: int = 2, bits: int = 16, most_bytes: int = 1 << 24,
    doc: str = "doc_id", text: str = "text",
) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of the vocabulary (see ``vocabulary``).

    Words are near if one insertion, deletion or replacement of a code point parts them. A word's form is its near word
    of greatest n, ties to the first in code-point order, if that n is at least ``factor`` (over 1) times its own; else
    null, as is form_n. ``root``: the last word reached by forms, the word itself if it has none. Repeated rows count
    as often as they stand; an empty table, or one without such words, gives no rows. Other columns are not read.

    The filters take ``bits`` a word and ``most_bytes`` in all; a vocabulary beyond that meets more false positives,
    which the exact join removes, so results never depend on either.
    """
    spark = documents.sparkSession
    common.small_batches(spark)
    words = common.written(vocabulary(documents, least_length, least_count, every, doc, text), "words")
    used = words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).distinct()
    letters = "".join(r.c for r in used.collect())
    filters = build_filters(words, bits, most_bytes)
    seen = candidates(words, filters, letters)
    pairs = seen.join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    sides = pairs.select(F.explode(F.array(
        F.struct("word", F.col("other").alias("near"), F.col("other_n").alias("near_n")), F.struct(F.col("other").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    )).alias("s")).select("s.*")
    nearest = sides.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("first"))
    judged = common.written(
        words.join(nearest, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(-F.col("first.less") >= factor * F.col("n"), F.struct(F.col("first.near").alias("form"), (-F.col("first.less")).alias("n"))).alias("f")
        ),
        "judged",
    )
    ends = roots(judged.where("f IS NOT NULL").select("word", F.col("f.form").alias("form")))
    return judged.join(ends, "word", "left").select(
        "word", F.col("f.form").alias("form"), F.coalesce("root", "word").alias("root"), "n", "n_near", F.col("f.n").alias("form_n"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group(common.table(spark, sf_dir, "documents", "doc_id", "text"))


SQL = """
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(CAST(i AS UBIGINT), list_transform(range(8), lambda s: CAST(0 AS UBIGINT))),
    lambda c, s: CASE WHEN c & 1 = 1 THEN xor(CAST(3988292384 AS UBIGINT), c >> 1) ELSE c >> 1 END)) AS t
), runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{00C0}-\\x{00FF}]+')) AS run FROM documents) r
), counted AS (
  SELECT d, run, count(*) AS n FROM runs WHERE length(run) >= 5 GROUP BY ALL
), hashed AS (
  SELECT run, n, CAST(xor(CAST(4294967295 AS UBIGINT), list_reduce(
      list_prepend(CAST(4294967295 AS UBIGINT), flatten(list_transform(string_split(concat(d, ':', run), ''), lambda c:
        CASE WHEN ord(c) < 128 THEN [CAST(ord(c) AS UBIGINT)] ELSE [CAST(192 + (ord(c) >> 6) AS UBIGINT), CAST(128 + (ord(c) & 63) AS UBIGINT)] END))),
      lambda a, b: xor(a >> 8, t[CAST((xor(a, b) & 255) AS INT) + 1]))) AS BIGINT) AS h
  FROM counted, crc
), words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT n, CASE WHEN h % 97 = 0 THEN concat(substr(run, 1, CAST(h % length(run) AS INT)), substr(run, CAST(h % length(run) AS INT) + 2)) ELSE run END AS word FROM hashed
  ) w WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), cut AS (
  SELECT word, n, i, concat(substr(word, 1, CAST(i AS INT)), substr(word, CAST(i AS INT) + 2)) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words) c
), near AS (
  SELECT DISTINCT a.word, b.word AS other, b.n FROM cut a JOIN words b ON b.word = a.rest
  UNION SELECT DISTINCT b.word, a.word, a.n FROM cut a JOIN words b ON b.word = a.rest
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
), firsts AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, encode(other)) AS form, max(n) AS form_n FROM near GROUP BY word
), judged AS (
  SELECT w.word, CASE WHEN f.form_n >= 2 * w.n THEN f.form END AS form, w.n, coalesce(f.n_near, 0) AS n_near, CASE WHEN f.form_n >= 2 * w.n THEN f.form_n END AS form_n
  FROM words w LEFT JOIN firsts f USING (word)
), chain AS (
  WITH RECURSIVE step AS (
    SELECT word, coalesce(form, word) AS goal, 1 AS depth FROM judged
    UNION ALL SELECT s.word, j.form, depth + 1 FROM step s JOIN judged j ON s.goal = j.word WHERE j.form IS NOT NULL
  )
  SELECT word, arg_max(goal, depth) AS root FROM step GROUP BY word
)
SELECT word, form, root, n, n_near, form_n FROM judged JOIN chain USING (word)
"""
