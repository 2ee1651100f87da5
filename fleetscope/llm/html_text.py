"""Main text of web pages by equivalence classes of template tokens.

Tokens are a page's tags with their class and id. Tokens with one occurrence vector over all pages of a
host form an equivalence class; classes that stand once on (nearly) every page, in one order, make the
host's template, in which the others nest. Between template tokens lie slots. Runs of words between block
tags are tokens too: those that stand alike on (nearly) every page are of the template and never text.
Slots of menus, notices and the like are part of the site; what the remaining slots hold is the page's own text.
"""

import hashlib
import html
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common, url_filter

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:"[^"]*"|'[^']*'|[^'">])*)>|<(/?)([A-Za-z][A-Za-z0-9:-]*)([^>]*)>""", re.S
)
_ATTRIBUTE = re.compile(r"""([^\s=/"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"']+))?""")
#: elements whose content is text of another kind, read up to their own end tag
_RAW = frozenset("script style noscript template textarea title iframe xmp noframes".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: elements that are never part of an article, and words in class, id or role that say the same
_SITE = frozenset("head nav footer aside form button select option dialog menu svg canvas object audio video map datalist label input fieldset search".split())
_SITE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner banners breadcrumb breadcrumbs comment comments commentlist consent contentinfo cookie cookies disqus "
    "footer gdpr masthead menu menus modal nav navbar navigation navmenu newsletter notice notices pager pagination popup promo promoted promotion replies reply "
    "respond search share sharing sidebar sitenav social sponsor sponsored sponsors subscribe subscription toolbar topbar widget widgets".split()
)
#: words that name a site element together with one of the above, as in share-buttons; with any other word (ad-hoc, social-history) a name says nothing
_SHAPES = frozenset("area bar block box btn button buttons container content footer form group header inner item items left link links list module outer panel post right row section slot top unit wrap wrapper".split())
#: elements that hold a part of the site by their class, id or role; paragraphs, headings, quotes and the like never do
_HOLDERS = frozenset("div ul ol dl table iframe span center a figure".split())
#: words that say it of a section too
_OF_SECTIONS = frozenset("comments commentlist disqus respond replies".split())
_SPLIT = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")
#: of a host's pages, the share a token must stand on (once) to be of its template
SUPPORT = 0.6
#: distinct pages of a host that words must stand on to be of its template
PAGES = 3
#: words of a block that is prose, by which the region is chosen
PROSE = 8


def _site(name: str, attributes: dict, within_article: bool) -> bool:
    if name in _SITE or (name == "header" and not within_article):
        return True
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attributes.get("style", "")):
        return True
    if name in _HOLDERS or name in ("section", ""):
        sure = _OF_SECTIONS if name == "section" else _SITE_WORDS
        for said in (f"{attributes.get('class', '')} {attributes.get('role', '')}".split() + attributes.get("id", "").split()):
            words = {w.lower() for w in _SPLIT.split(said)} - {""}
            if words & sure and words <= _SITE_WORDS | _SHAPES:
                return True
    return False


def tokens(page: str):
    """(start, end, closing, name, attributes) of every tag outside comments and raw elements."""
    at, out, size = 0, [], len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        if m is None:
            break
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            out.append((m.start(), at, False, "", {}))
            continue
        name, closing, text = name.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        attributes = {}
        if not closing and text.strip(" /"):
            for a in _ATTRIBUTE.finditer(text):
                attributes.setdefault(a[1].lower(), (a[2] or "").strip("\"'"))
        if name in _RAW and not closing:
            end = re.compile(rf"</{name}\s*[^>]*>", re.I).search(page, at)
            at = end.end() if end else size
            out.append((m.start(), at, False, "", {}))
            continue
        out.append((m.start(), at, closing, name, attributes))
    return out


def signature(closing: bool, name: str, attributes: dict) -> str:
    if closing:
        return f"/{name}"
    return name + "".join(f".{w}" for w in sorted(attributes.get("class", "").split())) + (f"#{attributes['id']}" if attributes.get("id") else "")


def words_token(text: str) -> str:
    """The token of a run of words between block tags; no tag's signature begins like it."""
    return "=" + hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()


def runs(page: str, found) -> list[str]:
    """The runs of words between block tags, in page order."""
    out, parts, last = [], [], 0
    for start, end, _, name, _ in [*found, (len(page), len(page), False, "body", {})]:
        parts.append(html.unescape(page[last:start]))
        last = end
        if name == "br":
            parts.append(" ")
        if name in _BLOCK:
            text = " ".join("".join(parts).split())
            if text:
                out.append(text)
            parts.clear()
    return out


def occurrences(pages: DataFrame, html_column: str = "html", url: str = "url") -> DataFrame:
    """(host, token, n, page, place): how often each token stands on each page, and where first, as a share of the page's tokens. Equal pages have one name."""
    rows = pages.select(url_filter.host_of(F.col(url)).alias("host"), F.xxhash64(html_column).alias("page"), F.col(html_column).alias("h"))

    def run(batches):
        for batch in batches:
            out = [[], [], [], [], []]
            for host, page, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                found = tokens(text or "")
                own = [signature(*t[2:]) for t in found if t[3]]
                first = {}
                for k, token in enumerate(own):
                    first.setdefault(token, k / len(own))
                counts = Counter(own)
                counts.update(map(words_token, runs(text or "", found)))
                for token, n in counts.items():
                    for column, value in zip(out, (host, token, n, page, first.get(token, 1.0))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.float64()))], ["host", "token", "n", "page", "place"])

    return rows.mapInArrow(run, "host string, token string, n long, page long, place double")


def templates(pages: DataFrame, html_column: str = "html", url: str = "url", support: float = SUPPORT) -> DataFrame:
    """(host, template): the tags of each host's root classes in page order, then the runs of words of its template.

    The occurrence vector of a token is summed into one number, page by page, so that no vector is ever
    gathered. A class of tags is valid for the root if its tokens stand exactly once wherever they stand, on at
    least ``support`` of the host's distinct pages; the rest (repeated tokens, rare ones) nests in the slots. A run of
    words is of the template if it stands on as many pages, and on ``PAGES`` at least. A host of one page has no
    template. At most as many tokens qualify as 1 / support pages hold.
    """
    found = occurrences(pages, html_column, url).groupBy("host", "token", "page").agg(F.max("n").alias("n"), F.min("place").alias("place"))
    per_token = found.groupBy("host", "token").agg(
        F.count("*").alias("pages"), F.max("n").alias("most"), F.sum(F.xxhash64("page", "n").cast("decimal(38,0)")).alias("vector"), F.avg("place").alias("place")
    )
    per_host = pages.select(url_filter.host_of(F.col(url)).alias("host"), F.xxhash64(html_column).alias("page")).groupBy("host").agg(F.count_distinct("page").alias("all"))
    valid = F.when(F.col("token").startswith("="), F.col("pages") >= PAGES).otherwise(F.col("most") == 1)
    classes = (
        per_token.where("most = 1 OR pages > 1").join(per_host, "host").where(valid & (F.col("all") > 1) & (F.col("pages") >= support * F.col("all")))
        .groupBy("host", "vector").agg(F.collect_list(F.struct("place", "token")).alias("members"))
    )
    flat = classes.groupBy("host").agg(F.array_sort(F.flatten(F.collect_list("members"))).alias("m"))
    return flat.select("host", F.transform("m", lambda x: x["token"]).alias("template"))


def slots(found, template) -> list[int]:
    """For each tag the number of template tokens met so far, in order; a token out of order is passed over."""
    at, out, place = 0, [], {t: k for k, t in enumerate(template)}
    for _, _, closing, name, attributes in found:
        k = place.get(signature(closing, name, attributes)) if name else None
        if k is not None and k >= at:
            at = k + 1
        out.append(at)
    return out


def main_text(page: str | None, template=()) -> str:
    """Blocks of the page's own text, one a line.

    The template's next token ends whatever the page left open before it, so that an unclosed menu does not
    swallow the article; the template's runs of words are no text. The region is the article elements if they
    hold half of the words of prose at least, else the main element if that does, else all that is not of the
    site. A page that is nothing but template keeps its text.
    """
    if not page:
        return ""
    found = tokens(page)
    names = {t[3] for t in found if not t[2]}
    for known in (template, [t for t in template if not t.startswith("=")]):
        every = _region(page, found, known, None)
        most = sum(map(_prose, every))
        for wanted in ("article", "main"):
            if wanted in names:
                blocks = _region(page, found, known, wanted)
                if blocks and 2 * sum(map(_prose, blocks)) >= most:
                    return "\n".join(blocks)
        if every:
            return "\n".join(every)
    return ""


def _prose(block: str) -> int:
    n = len(block.split())
    return n if n >= PROSE else 0


def _region(page: str, found, template, wanted: str | None) -> list[str]:
    """The blocks inside ``wanted`` elements, or anywhere, that are neither of the site nor words of the template."""
    where = slots(found, template)
    frame = set(template)
    of_words = any(t.startswith("=") for t in frame)
    blocks, parts, whole = [], [], []
    stack: list[tuple[str, bool, bool]] = []  # (name, of the site, opened by the template)
    inside, last = 0, 0

    def flush():
        text = " ".join("".join(parts).split())
        if text and not (of_words and words_token(" ".join("".join(whole).split())) in frame):
            blocks.append(text)
        parts.clear()
        whole.clear()

    def take(upto):
        if last < upto:
            text = html.unescape(page[last:upto])
            whole.append(text)
            if (inside or wanted is None) and not any(s[1] for s in stack):
                parts.append(text)

    for k, (start, end, closing, name, attributes) in enumerate(found):
        take(start)
        last = end
        if not name:
            continue
        landmark = where[k] > (where[k - 1] if k else 0) and signature(closing, name, attributes) in frame
        if name in _BLOCK:
            flush()
        if closing:
            depth = next((d for d in range(len(stack) - 1, -1, -1) if stack[d][0] == name), None)
            if depth is not None:
                inside -= sum(s[0] == wanted for s in stack[depth:])
                del stack[depth:]
            continue
        if name in _VOID:
            if name == "br":
                parts.append(" ")
                whole.append(" ")
            continue
        if landmark and not (inside and name != wanted):
            # what is open and not of the template ends here
            while stack and not stack[-1][2]:
                inside -= stack.pop()[0] == wanted
        elif name in _BLOCK and stack and stack[-1][0] == "p":
            stack.pop()
        if name == "body" or name == wanted:
            stack[:] = [s for s in stack if s[0] != "head" and not (s[1] and landmark)]
        of_site = _site(name, attributes, inside > 0 or any(s[0] == "article" for s in stack)) and name not in ("html", "body", wanted)
        stack.append((name, of_site or (name == wanted and inside > 0 and _site("", attributes, True)), landmark))
        inside += name == wanted
    take(len(page))
    flush()
    return blocks


def extract(pages: DataFrame, page: str = "page_id", url: str = "url", html_column: str = "html") -> DataFrame:
    """``page``, ``url``, text, n_chars for every row.

    Null and empty html have no text; a null url's host is empty, and its pages share a template like any
    other host's. Repeated rows stay, an empty table gives none; other columns are not read. Whole pages are
    read, twice: once for the templates, of which there is one short row for each host, and once for the text.
    """
    common.small_batches(pages.sparkSession)
    found = common.written(templates(pages, html_column, url), "templates")
    rows = pages.select(F.col(page).alias("p"), F.col(url).alias("u"), F.col(html_column).alias("h"), url_filter.host_of(F.col(url)).alias("host"))
    rows = rows.join(found, "host", "left").select("p", "u", "h", "template")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches):
        for batch in batches:
            texts = [main_text(h, t or ()) for h, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(np.fromiter(map(len, texts), np.int64, len(texts)))], ["p", "u", "text", "n_chars"])

    return rows.mapInArrow(run, f"p {kinds['p']}, u {kinds['u']}, text string, n_chars long").withColumnsRenamed({"p": page, "u": url})


def query(spark, sf_dir):
    return extract(common.table(spark, sf_dir, "pages", "page_id", "url", "html"))


SQL = None
