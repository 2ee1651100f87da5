"""A Spark data source for log folders: lines with their file, place and time, in batch and as a stream.

    spark.dataSource.register(LogFiles)
    spark.read.format("log_files").load("/logs")

Files are cut into splits of ``splitBytes``; a split yields the lines that begin in it, so a file of any size spreads
over tasks and no line is lost or doubled. A line's ``offset`` is its first byte, which orders the lines of a file. ``ts``
is the time at which the file was last changed when it was listed: it never goes back along a file's lines.

The stream's position is the end of the last whole line of each file; a restart from a checkpoint reads on
from there. A line without its newline waits for it in the stream, and counts as a line in batch. A file that shrank
was written anew and is read from its beginning. Any store that Arrow's file systems know can hold the folder.
"""

from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "file string, offset bigint, ts timestamp, text string"
_BLOCK = 1 << 20


@dataclass
class Split(InputPartition):
    file: str
    low: int
    high: int
    first: int
    mtime_us: int


def _store(path: str):
    """(file system, path in it, what to put before it again)."""
    from pyarrow import fs

    if "://" not in path:
        return fs.LocalFileSystem(), path.removeprefix("file:"), ""
    store, inside = fs.FileSystem.from_uri(path)
    return store, inside, path[: len(path) - len(inside)] if path.endswith(inside) else ""


def _listing(root: str, ending: str) -> dict[str, tuple[int, int]]:
    """File: (size, time of its last change in microseconds)."""
    from pyarrow import fs

    store, inside, _ = _store(root)
    found = store.get_file_info(fs.FileSelector(inside, recursive=True, allow_not_found=True))
    return {i.path: (i.size, i.mtime_ns // 1000 if i.mtime_ns else 0) for i in found if i.type == fs.FileType.File and i.path.endswith(ending)}


def _last_line_end(stream, low: int, size: int) -> int:
    """Place after the last newline in [low, size), or low."""
    at = size
    while at > low:
        start = max(low, at - _BLOCK)
        stream.seek(start)
        cut = stream.read(at - start).rfind(b"\n")
        if cut >= 0:
            return start + cut + 1
        at = start
    return low


def _splits(file: str, low: int, high: int, mtime_us: int, size: int) -> list[Split]:
    return [Split(file, at, min(high, at + size), low, mtime_us) for at in range(low, high, size)]


def lines_of(stream, split: Split):
    """(offset, bytes without the newline) of the lines that begin in the split. ``first`` begins a line."""
    at = split.low
    if at > split.first:
        # the line over the border belongs to the split before; one byte back tells whether there is one
        at -= 1
    stream.seek(at)
    held, begin, skip = b"", at, split.low > split.first
    while True:
        block = stream.read(_BLOCK)
        pieces = (held + block).split(b"\n")
        held = pieces.pop()
        for piece in pieces:
            if skip:
                skip = False
            elif begin < split.high:
                yield begin, piece
            begin += len(piece) + 1
            if begin >= split.high:
                return
        if not block:
            if held and not skip and begin < split.high:
                yield begin, held
            return


class _Reader:
    def __init__(self, options: dict):
        self.root, self.ending, self.size = options["path"], options.get("ending", ".log"), int(options.get("splitbytes", 64 << 20))

    def read(self, split: Split):
        import pyarrow as pa

        store, _, _ = _store(self.root)
        places, texts = [], []

        def rows():
            n = len(places)
            return pa.RecordBatch.from_arrays(
                [pa.array([split.file] * n), pa.array(places, pa.int64()), pa.array([split.mtime_us] * n, pa.timestamp("us", "UTC")), pa.array(texts, pa.string())],
                ["file", "offset", "ts", "text"],
            )

        held = 0
        with store.open_input_file(split.file) as stream:
            for place, line in lines_of(stream, split):
                places.append(place)
                texts.append(line.removesuffix(b"\r").decode("utf-8", "replace"))
                held += len(line)
                if len(places) >= 10_000 or held > _BLOCK:
                    yield rows()
                    places, texts, held = [], [], 0
        if places:
            yield rows()


class _Batch(_Reader, DataSourceReader):
    def partitions(self):
        return [s for file, (size, mtime) in sorted(_listing(self.root, self.ending).items()) for s in _splits(file, 0, size, mtime, self.size)] or [Split("", 0, 0, 0, 0)]

    def read(self, split):
        return _Reader.read(self, split) if split.file else iter(())


class _Stream(_Reader, DataSourceStreamReader):
    def initialOffset(self):
        return {}

    def latestOffset(self):
        """Ends of the last whole lines. Only files that changed are opened, and only their new end is looked at."""
        known, now = getattr(self, "known", {}), {}
        store, _, _ = _store(self.root)
        for file, (size, mtime) in sorted(_listing(self.root, self.ending).items()):
            before = known.get(file)
            if before and before[:2] == [size, mtime]:
                now[file] = before
                continue
            low = before[2] if before and before[2] <= size else 0
            with store.open_input_file(file) as stream:
                now[file] = [size, mtime, _last_line_end(stream, low, size)]
        self.known = now
        return now

    def partitions(self, start, end):
        splits = []
        for file, (_, mtime, high) in sorted(end.items()):
            low = start[file][2] if file in start and start[file][2] <= high else 0
            splits += _splits(file, low, high, mtime, self.size)
        return splits or [Split("", 0, 0, 0, 0)]

    def read(self, split):
        return _Reader.read(self, split) if split.file else iter(())

    def commit(self, end):
        pass


class LogFiles(DataSource):
    """Options: ``path``, ``ending`` (.log), ``splitBytes``."""

    @classmethod
    def name(cls):
        return "log_files"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Batch(self.options)

    def streamReader(self, schema):
        return _Stream(self.options)
