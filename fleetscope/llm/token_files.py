"""Token-id files: a wavelet matrix for each shard.

A shard holds the token ids of whole documents as bit-planes, from the highest bit down; each plane is
ordered by the bits above it, zeros before ones. With ranks over the planes, one compressed record answers
what token stands at a place, how often a token occurs before it, and where its k-th occurrence is.
"""

import array
import codecs
import re
import zlib

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import common

END = 2
SHARD = 1 << 20
#: words of a text that are looked up together
AT_ONCE = 1 << 16


class WaveletMatrix:
    """Ids of ``bits`` bits: one plane for each bit, and the number of zeros in each."""

    def __init__(self, planes: list[np.ndarray], zeros: list[int], n: int):
        self.planes, self.zeros, self.n = planes, zeros, n
        self._ranks: list[np.ndarray] | None = None

    @classmethod
    def build(cls, ids: np.ndarray, bits: int):
        planes, zeros = [], []
        for level in range(bits - 1, -1, -1):
            ones = (ids & ids.dtype.type(1 << level)).astype(bool)
            planes.append(ones)
            low = np.flatnonzero(~ones)  # places are faster than masks, since bits come in no order
            zeros.append(len(low))
            ids = np.concatenate((ids.take(low), ids.take(np.flatnonzero(ones))))
        return cls(planes, zeros, len(ids))

    def to_bytes(self) -> bytes:
        pack = zstandard.ZstdCompressor(level=1)
        parts = [pack.compress(np.packbits(p).tobytes()) for p in self.planes]
        head = np.array([self.n, len(parts), *map(len, parts), *self.zeros], "<i8").tobytes()
        return head + b"".join(parts)

    @classmethod
    def from_bytes(cls, raw: bytes):
        n, bits = (int(x) for x in np.frombuffer(raw, "<i8", 2))
        table = np.frombuffer(raw, "<i8", 2 * bits, 16)
        unpack, at, planes = zstandard.ZstdDecompressor(), 16 + 16 * bits, []
        for size in table[:bits]:
            packed = unpack.decompress(raw[at : at + int(size)], max_output_size=max(1, n // 8 + 1))
            planes.append(np.unpackbits(np.frombuffer(packed, np.uint8), count=n).astype(bool))
            at += int(size)
        return cls(planes, [int(z) for z in table[bits:]], n)

    def decode(self) -> np.ndarray:
        """All ids, from the last plane's order back to the first's."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        out = np.zeros(self.n, kind)
        for depth in range(len(self.planes) - 1, -1, -1):
            ones, up = self.planes[depth], np.empty(self.n, kind)
            up[np.flatnonzero(~ones)] = out[: self.zeros[depth]]
            up[np.flatnonzero(ones)] = out[self.zeros[depth] :] | kind(1 << (len(self.planes) - 1 - depth))
            out = up
        return out.astype(np.uint32)

    @property
    def ranks(self) -> list[np.ndarray]:
        """Ones before each place of each plane; made on first use."""
        if self._ranks is None:
            self._ranks = [np.concatenate(([0], np.cumsum(p, dtype=np.int64))) for p in self.planes]
        return self._ranks

    def access(self, at: int) -> int:
        token = 0
        for plane, zero, ones in zip(self.planes, self.zeros, self.ranks):
            bit = bool(plane[at])
            token = token << 1 | bit
            at = zero + int(ones[at]) if bit else at - int(ones[at])
        return token

    def _range(self, token: int, upto: int) -> tuple[int, int]:
        """Where the token's occurrences before ``upto`` lie below the last plane."""
        low, high = 0, upto
        for depth, (zero, ones) in enumerate(zip(self.zeros, self.ranks)):
            if token >> (len(self.planes) - 1 - depth) & 1:
                low, high = zero + int(ones[low]), zero + int(ones[high])
            else:
                low, high = low - int(ones[low]), high - int(ones[high])
        return low, high

    def rank(self, token: int, upto: int | None = None) -> int:
        """Occurrences of the token before place ``upto`` (default: in all)."""
        if token >> len(self.planes):
            return 0
        low, high = self._range(token, self.n if upto is None else upto)
        return high - low

    def select(self, token: int) -> np.ndarray:
        """Places of all occurrences, in order."""
        if token >> len(self.planes):
            return np.empty(0, np.int64)
        low, high = self._range(token, self.n)
        at = np.arange(low, high)
        for depth in range(len(self.planes) - 1, -1, -1):
            ones, zero = self.ranks[depth], self.zeros[depth]
            if token >> (len(self.planes) - 1 - depth) & 1:
                at = np.searchsorted(ones, at - zero + 1, side="left") - 1
            else:
                at = np.searchsorted(np.arange(self.n + 1) - ones, at + 1, side="left") - 1
        return at


#: fixed: the pieces that byte-level BPE cuts a text into before it merges bytes
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_TOUCHING = re.compile(r"\s\s|\x00")
_PLAIN = regex.compile("[\\n!-~¡-ɏ]*")
#: marks that make one piece where they end a word
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


class _Known(dict):
    """Words and the bytes of their ids; a word that is not there is learnt."""

    def __init__(self, learn):
        self.learn = learn

    def __missing__(self, word: str):
        return self.learn(word)


class Encoder:
    """A byte-level BPE tokenizer of the tokenizers library that remembers words.

    A space between two other characters always starts a piece, so a text is the sum of its words, each with
    its space, and a word is encoded once while it is remembered. Texts with touching white space or special
    tokens go to the library whole, words with uncommon letters one by one. Words without a space before them are
    remembered with a \\x00 before them; a word of several pieces is put together from theirs.

    Two generations of words are kept, each closed once it holds ``most_bytes`` of words and ids (by an estimate of what
    Python needs for them) or more than ``words`` of them; a word of the elder that is met again moves to the younger, so that frequent words stay.
    """

    def __init__(self, path: str, words: int | None = None, most_bytes: int = 100 << 20):
        from tokenizers import Tokenizer

        self.tokenizer, self.words, self.limit = Tokenizer.from_file(path), words, most_bytes
        pieces = Tokenizer.from_file(path)
        # the library's own memory of pieces takes as long as the merging of a new one, and all of them are new here
        pieces.model._resize_cache(0)
        self.tokenize = pieces.model.tokenize
        self.bits = max(1, (max(self.tokenizer.get_vocab(True).values())).bit_length())
        self.kind = np.dtype("u2" if self.bits <= 16 else "u4")
        self.code = next(c for c in "HIL" if array.array(c).itemsize == self.kind.itemsize)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        letters = {b: b for b in shown} | {b: 256 + k for k, b in enumerate(hidden)}
        self.letters = "".join(chr(letters[b]) for b in range(256))
        self.line = self._packed([t.id for t in self.tokenize(self.letters[10])])
        self.known = _Known(self._learn)
        self._turn()

    def _turn(self):
        """The younger generation becomes the elder one."""
        self.elder, self.known, self.bytes = (self.known,), _Known(self._learn), 0

    def _learn(self, word: str):
        """Takes a word over from the elder generation, or encodes it."""
        ids = self.elder[0].get(word, word)
        if ids is word:
            ids = self._ids(word)
        self.known[word] = ids
        # a word in a dictionary and its ids take some 160 bytes besides its letters
        self.bytes += 160 + len(word) + len(ids or b"")
        return ids

    def _ids(self, word: str):
        """The bytes of a word's ids; None if it holds or touches white space that may touch more."""
        if word.isascii() and word.isalpha():
            return self._packed([t.id for t in self.tokenize("\u0120" + word)])
        if word == "\x00":
            return b""
        stem = word.rstrip(_MARKS)
        if len(stem) < len(word) and stem.isalpha() and (stem.isascii() or _PLAIN.fullmatch(stem)):
            return self.known[stem] + self.known["\x00" + word[len(stem) :]]
        lines = word.split("\n")
        if len(lines) > 1 and all(lines) and lines[0] != "\x00":  # a line break between two other characters is a piece
            ids = [self.known[lines[0]], *[self.known["\x00" + w] for w in lines[1:]]]
            return None if None in ids else self.line.join(ids)
        first = word[:1] == "\x00"
        text = word[1:] if first else " " + word
        own = text[not first :]
        if not own or own[0].isspace() or own[-1].isspace() or _TOUCHING.search(own):
            return None
        if not (own.isascii() and own.isprintable() or _PLAIN.fullmatch(own)):
            return self._packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        pieces = _PIECES.findall(text)
        if len(pieces) > 1:
            return b"".join([self._piece(p) for p in pieces])
        return self._packed([t.id for t in self.tokenize(codecs.charmap_decode(text.encode(), "strict", self.letters)[0])])

    def _piece(self, piece: str) -> bytes:
        if piece == "\n":
            return self.line
        return self.known[piece[1:] if piece[0] == " " else "\x00" + piece]

    def _packed(self, ids: list[int]) -> bytes:
        return array.array(self.code, ids).tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        return [np.frombuffer(self._encode(t), self.kind) for t in texts]

    def _encode(self, text: str) -> bytes:
        if "\x00" in text or any(s in text for s in self.special):
            return self._packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        words = text.split(" ")
        words[0] = "\x00" + words[0]
        out = []
        for low in range(0, len(words), AT_ONCE):
            if self.bytes > self.limit or (self.words is not None and len(self.known) > self.words):
                self._turn()
            some = words[low : low + AT_ONCE]
            try:
                out.append(b"".join(map(self.known.__getitem__, some)))
            except TypeError:  # a word is None
                if _TOUCHING.search(text):
                    return self._packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
                for word in some:
                    ids = self.known[word]
                    out.append(self._packed(self.tokenizer.encode(word[1:] if word[:1] == "\x00" else " " + word, add_special_tokens=False).ids) if ids is None else ids)
        return b"".join(out)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def forget(path: str) -> None:
    """Lets go of a worker's own; a function of the module, since tasks get copies of what theirs name."""
    _encoders.pop(path, None)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def write(documents: DataFrame, path: str, tokenizer: str | None = None, end: int = END, shard: int = SHARD, doc: str = "doc_id", text: str = "text", keep: bool = True) -> None:
    """Writes the shards of ``documents`` to ``path``, a Parquet table of (part, seq, n_tokens, docs, counts, matrix).

    Ids are cut into ranges, one task each; a task encodes its documents in order of id and closes a shard
    once it has ``shard`` tokens. (part, seq) order the shards. ``matrix`` is the compressed wavelet matrix.
    Every document ends with the token ``end``. Null texts are empty; null ids come first; documents of
    one id are ordered by text. An empty table gives an empty one. Other columns are not read.
    Workers ``keep`` the words they know for later tasks, some 250 MB each; without, they give them back after each task.
    """
    common.small_batches(documents.sparkSession)
    tokenizer = tokenizer or default_tokenizer()
    rows = documents.select(F.col(doc).alias("d"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    kind = rows.schema["d"].dataType.simpleString()
    rows = rows.repartitionByRange("d").sortWithinPartitions("d", "t")

    def run(batches):
        own = encoder(tokenizer)
        part, seq, docs, counts, held = TaskContext.get().partitionId(), 0, [], [], []
        tokens = 0

        def close():
            ids = np.concatenate(held)
            matrix = WaveletMatrix.build(ids.astype(np.uint16) if own.bits <= 16 else ids, max(own.bits, int(end).bit_length())).to_bytes()
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([tokens], pa.int64()), pa.array([docs], pa.list_(batch.schema.field(0).type)), pa.array([counts], pa.list_(pa.int64())), pa.array([matrix], pa.binary())],
                ["part", "seq", "n_tokens", "docs", "counts", "matrix"],
            )

        for batch in batches:
            for d, ids in zip(batch.column(0).to_pylist(), own.encode(batch.column(1).to_pylist())):
                docs.append(d)
                counts.append(len(ids) + 1)
                held.append(np.append(ids, np.uint32(end)))
                tokens += len(ids) + 1
                if tokens >= shard:
                    yield close()
                    seq, tokens, docs, counts, held = seq + 1, 0, [], [], []
        if docs:
            yield close()
        held.clear()
        if not keep:
            own = None
            forget(tokenizer)
        common.give_back()

    rows.mapInArrow(run, f"part int, seq int, n_tokens long, docs array<{kind}>, counts array<long>, matrix binary").write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def starts(shards: DataFrame) -> DataFrame:
    """(part, seq, base): ids in all shards before each: totals run inside a part, and over the parts, one row each."""
    sizes = shards.select("part", "seq", "n_tokens")
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("all")).select("part", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("low"))
    return sizes.withColumn("own", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(parts, "part").select("part", "seq", (F.col("low") + F.col("own")).alias("base"))


def documents_in(shards: DataFrame, doc: str = "doc_id") -> DataFrame:
    """``doc``, start, n_tokens, ids_crc32 of every document, from the ids the files hold."""
    kind = shards.schema["docs"].dataType.elementType.simpleString()

    def run(batches):
        for batch in batches:
            for part, seq, docs, counts, raw in zip(*(batch.column(n).to_pylist() for n in ("part", "seq", "docs", "counts", "matrix"))):
                ids = WaveletMatrix.from_bytes(raw).decode().astype("<u4").tobytes()
                at = np.concatenate(([0], np.cumsum(counts)))
                sums = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(at[:-1], at[1:])]
                n = len(docs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * n, pa.int32()), pa.array([seq] * n, pa.int32()), pa.array(docs, batch.schema.field("docs").type.value_type), pa.array(at[:-1], pa.int64()), pa.array(counts, pa.int64()), pa.array(sums, pa.int64())],
                    ["part", "seq", "d", "low", "n_tokens", "ids_crc32"],
                )

    rows = shards.select("part", "seq", "docs", "counts", "matrix").mapInArrow(run, f"part int, seq int, d {kind}, low long, n_tokens long, ids_crc32 long")
    return rows.join(starts(shards), ["part", "seq"]).select(F.col("d").alias(doc), (F.col("base") + F.col("low")).alias("start"), "n_tokens", "ids_crc32")


def occurrences(shards: DataFrame, token: int) -> DataFrame:
    """(place) of every occurrence of a token among all ids, by select in each shard."""

    def run(batches):
        for batch in batches:
            for part, seq, raw in zip(*(batch.column(n).to_pylist() for n in ("part", "seq", "matrix"))):
                at = WaveletMatrix.from_bytes(raw).select(token)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), part, np.int32)), pa.array(np.full(len(at), seq, np.int32)), pa.array(at, pa.int64())], ["part", "seq", "low"])

    rows = shards.select("part", "seq", "matrix").mapInArrow(run, "part int, seq int, low long")
    return rows.join(starts(shards), ["part", "seq"]).select((F.col("base") + F.col("low")).alias("place"))


def token_counts(shards: DataFrame, tokens: list[int]) -> DataFrame:
    """(token, n): how often each of the tokens occurs, by rank in each shard."""
    tokens = sorted(set(tokens))

    def run(batches):
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                matrix = WaveletMatrix.from_bytes(raw)
                yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.int64()), pa.array([matrix.rank(t) for t in tokens], pa.int64())], ["token", "n"])

    return shards.select("matrix").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def round_trip(documents: DataFrame, path: str | None = None, doc: str = "doc_id", text: str = "text", keep: bool = True) -> DataFrame:
    """Writes the files (to the shared folder, if no path is given) and returns ``documents_in`` what they hold."""
    import uuid

    spark = documents.sparkSession
    path = path or f"{common.shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write(documents, path, doc=doc, text=text, keep=keep)
    return documents_in(read(spark, path), doc)


def query(spark, sf_dir):
    return round_trip(common.table(spark, sf_dir, "documents", "doc_id", "text"))


SQL = None
