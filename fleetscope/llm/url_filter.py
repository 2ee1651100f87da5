"""URL filter: a bit-parallel wildcard automaton over canonical URLs.

All glob rules are packed side by side into one bit vector of 64-bit words. One step of the automaton
takes one byte of every URL of a batch: shift, mask with the byte's row, keep the bits of wildcards.
"""

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import common

#: marks the end of the host inside a canonical URL; no host and no path can hold it after ``canonical``
_END = 0x1F


@dataclass(frozen=True)
class Rule:
    """``host`` and all its subdomains, paths that start with ``path``; ``*`` stands for any run, in a host within the host."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: fixed rules of the query's contract; the longest that fits decides
RULES = (
    Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"),
)
#: judge URLs that no rule fits: blocked when one of these globs fits, else allowed
METHOD = tuple(Rule("block", f"*{word}*", "") for word in ("adult-", "casino-", "cheap-pills", "free-bets", "spam-farm", "ads-track"))


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, common.CAPITALS, common.SMALL), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class Automaton:
    """Shift-And masks for many globs at once, each over ``.host<end>path<end>``.

    A pattern's literal bytes take one bit each. A wildcard takes none: the bit before it keeps itself
    alive on the bytes the wildcard may pass (in a host anything but the end mark, in a path anything).
    """

    def __init__(self, rules):
        literal, loop_host, loop_path, starts, finals = [], set(), set(), [], []
        for rule in rules:
            # the leading dot of the canonical host lets "org" fit "org" and "x.org" but not "xorg"
            glob = [("*", True), *((c, True) for c in "." * (not rule.host.startswith("*")) + rule.host)]
            glob += [(chr(_END), True), *((c, False) for c in rule.path + "*"), (chr(_END), False)]
            starts.append(len(literal))
            literal.append(None)  # a state before the first byte, alive from the start
            for char, in_host in glob:
                if char == "*":
                    (loop_host if in_host else loop_path).add(len(literal) - 1)
                else:
                    literal.extend(char.encode())
            finals.append(len(literal) - 1)
        self.words = (len(literal) + 63) // 64
        self.accept = np.zeros((256, self.words), np.uint64)  # bits whose literal is this byte
        self.keep = np.zeros((256, self.words), np.uint64)  # bits that stay alive on this byte
        self.initial = np.zeros(self.words, np.uint64)
        for i, byte in enumerate(literal):
            if byte is not None:
                self.accept[byte, i // 64] |= np.uint64(1 << (i % 64))
        for i in loop_host | loop_path:
            self.keep[:, i // 64] |= np.uint64(1 << (i % 64))
        for i in loop_host - loop_path:
            self.keep[_END, i // 64] &= ~np.uint64(1 << (i % 64))
        for i in starts:
            self.initial[i // 64] |= np.uint64(1 << (i % 64))
        self.finals = finals

    def fits(self, texts: list[bytes]) -> np.ndarray:
        """[text, rule]: whether the rule fits. Longest texts first, so that finished ones fall off the end of the batch."""
        lengths = np.array([len(t) for t in texts])
        order = np.argsort(-lengths, kind="stable")
        flat = np.frombuffer(b"".join(texts[i] for i in order), np.uint8)
        size = lengths[order]
        begin = np.concatenate(([0], np.cumsum(size)))[:-1]
        state = np.tile(self.initial, (len(texts), 1))
        for at in range(int(size[0]) if len(size) else 0):
            live = int(np.searchsorted(-size, -at, side="left"))
            byte = flat[begin[:live] + at]
            now = state[:live]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:live] = (moved & self.accept[byte]) | (now & self.keep[byte])
        found = np.empty((len(texts), len(self.finals)), bool)
        for k, bit in enumerate(self.finals):
            found[order, k] = (state[:, bit // 64] >> np.uint64(bit % 64)) & np.uint64(1)
        return found


def canonical(host: str, path: str) -> bytes:
    mark = chr(_END)
    return f".{host.replace(mark, '?')}{mark}{path.replace(mark, '?')}{mark}".encode("utf-8", "surrogatepass")


def judge(pages: DataFrame, rules=RULES, method=METHOD, url: str = "url", keep=("page_id",)) -> DataFrame:
    """``keep`` columns, host, path, rule, verdict for every row.

    A null URL and one without ``://`` have an empty host and path; no rule fits an empty host. Of the
    rules that fit, the longest text decides, then the first listed. Where none fits, the URL is blocked
    if a glob of ``method`` fits and allowed otherwise. Rows are judged one by one: repeated rows stay,
    an empty table gives none, other columns are not read. Duplicated column names cannot arise, as only
    ``keep`` and the four results are returned. No shuffle.
    """
    rules, method = tuple(rules), tuple(method)
    rank = sorted(range(len(rules)), key=lambda i: (-len(rules[i].text), i))
    machine = Automaton((*rules, *method))
    rows = pages.select(*keep, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    names = rows.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", rule string, verdict string"

    def run(batches):
        for batch in batches:
            hosts, paths = batch.column(len(names) - 2).to_pylist(), batch.column(len(names) - 1).to_pylist()
            found = machine.fits([canonical(h, p) for h, p in zip(hosts, paths)])
            best = [next((i for i in rank if row[i]), None) if host else None for row, host in zip(found, hosts)]
            blocked = found[:, len(rules):].any(axis=1)
            rule = [None if i is None else rules[i].text for i in best]
            verdict = [("block" if b else "allow") if i is None else rules[i].verdict for i, b in zip(best, blocked)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], [*names, "rule", "verdict"])

    return rows.mapInArrow(run, schema)


def query(spark, sf_dir):
    return judge(common.table(spark, sf_dir, "pages", "page_id", "url"))


def _sql() -> str:
    fits = "\n".join(
        f"  SELECT '{r.text}' AS rule, '{r.verdict}' AS verdict, '{r.host}' AS h, '{r.path}' AS p" + " UNION ALL" * (i < len(RULES) - 1)
        for i, r in enumerate(RULES)
    )
    bad = " OR ".join(f"host LIKE '%{re.sub(r'[*]', '', r.host)}%'" for r in METHOD)
    return f"""
WITH parts AS (
  SELECT page_id, row_number() OVER () AS n,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{common.CAPITALS}', '{common.SMALL}') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), rules AS (
{fits}
), best AS (
  SELECT parts.n, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY parts.n
)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN {bad} THEN 'block' ELSE 'allow' END) AS verdict
FROM parts LEFT JOIN best USING (n)
"""


SQL = _sql()
