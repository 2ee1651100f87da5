"""Nulls, empty and long texts, ties, repeated rows, empty tables and extra columns, for every operator."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetscope.llm import (
    common, decontaminate, graph, html_text, jaccard_join, mixing, neighbours, quality, secrets, substring_dedup, token_files, url_filter,
)

WORDS = [f"w{i}x" for i in range(400)]
LONG = " ".join(WORDS * 60)
TEXTS = [
    (1, "alpha beta gamma delta epsilon zeta"), (2, "alpha beta gamma delta epsilon zeta"), (2, "alpha beta gamma delta epsilon zeta"),
    (3, None), (4, ""), (5, " \t\n "), (None, "password = abcdef123"), (6, LONG), (7, LONG + " tail"), (8, "#"),
]


@pytest.fixture(scope="module")
def docs(spark):
    """Extra columns carry names that operators use inside."""
    rows = [(d, t, "en", "src0", None, 1, "c", 2) for d, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, d long, cls string, score int")


def by_id(df, key="doc_id"):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: (r[key] is not None, r[key]))


def test_words_as_numbers_follow_the_definition():
    text = "Ab  cd\tÀB ab\x0bcd"
    words = re.findall(r"[^\x20\x09-\x0D]+", text.translate(str.maketrans(common.CAPITALS, common.SMALL)))
    got = common.word_hashes(text)
    assert len(got) == len(words) == 5
    assert [list(got).index(h) for h in got] == [words.index(w) for w in words]
    assert len(common.word_hashes(None)) == len(common.word_hashes(" ")) == 0
    assert len(common.shingles(got, 4)) == 2 and len(common.shingles(got[:2], 4)) == 1


# ---- secrets


def plain_spans(text):
    text, out = text or "", []
    for order, rule in enumerate(secrets.RULES + secrets.MORE):
        for m in re.finditer(rule.pattern, text):
            if len(m[rule.group]) >= rule.least:
                out.append((m.start(), order, m.end(), rule.kind))
    return sorted(out)


SECRETS = [
    None, "", "token=token:abcdefgh", "token=abc secret: 'é' password=\"a.b/c=d-e\" API_KEY : zzzzzz", "AKIA" + "A" * 16 + " AKIA123",
    "0" * 23 + "g" + "f" * 24 + " Password=" + "0" * 30, "é" * 5 + " passwd:=abcdef", "-----BEGIN RSA PRIVATE KEY-----", "eyJaaaaaaaaaaaaaaaaaa.eyJbbbbbbbbbbbbbbbbbb.cccccccc",
    "pas ass ssw swo wor ord", "x" * 100_000 + " secret=abcdef",
]


def test_secret_spans_equal_a_plain_scan(spark):
    rows = [(i, t, 0) for i, t in enumerate(SECRETS)] + [(None, "token=abcdefg", 0), (3, SECRETS[3], 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, rules int")
    got = sorted((r.doc_id is not None, r.doc_id or 0, [tuple(x) for x in r.found]) for r in secrets.scan(df, block=4).collect())
    assert got == sorted((d is not None, d or 0, plain_spans(t)) for d, t, _ in rows)
    assert secrets.scan(df.limit(0)).count() == 0


def test_trigram_queries_hold_for_every_match():
    low = lambda t: {t.lower()[i : i + 3] for i in range(len(t) - 2)}
    for rule in secrets.RULES + secrets.MORE:
        query = secrets.trigram_query(rule.pattern)
        for text in SECRETS:
            if text and re.search(rule.pattern, text):
                assert any(a <= low(text) for a in query)
    assert secrets.trigram_query("[0-9a-f]+") == secrets.TRUE and secrets.trigram_query("(abc|x)y*") == secrets.TRUE
    assert secrets.trigram_query("(abcd|xyz)?z") == secrets.TRUE
    assert secrets.trigram_query("(abc|xyz)+") == {frozenset(["abc"]), frozenset(["xyz"])}


# ---- mixing


def test_budgets_fill_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "x", "1", 10), ("a", "x", "2", 1000), ("a", "y", "1", 50), ("b", "x", "1", 1000)], "domain string, lang string, source string, tokens long")
    got = {(r.domain, r.lang, r.source): r.target for r in mixing.budgets(leaves, {("a",): 3}, F.lit(800), 1).collect()}
    # a has 600 of 800: y can take 50 only, so x has 550, of which source 1 can take 10
    assert got == {("a", "x", "1"): 10, ("a", "x", "2"): 540, ("a", "y", "1"): 50, ("b", "x", "1"): 200}
    short = {(r.domain, r.lang, r.source): r.target for r in mixing.budgets(leaves.where("source = '1'"), {}, F.lit(10_000), 2).collect()}
    assert short == {("a", "x", "1"): 20, ("a", "y", "1"): 100, ("b", "x", "1"): 2000}


def test_mixture_small_cases(spark, docs):
    got = mixing.mix(docs, share=1.0, epochs=1, bucket_rows=2)
    total = sum(len((t or "").split()) for _, t in TEXTS)
    assert got.agg(F.sum("take")).first()[0] == total
    assert {r.doc_id for r in got.collect()} == {1, 2, None, 6, 7, 8}
    half = mixing.mix(docs, share=0.5, bucket_rows=1).collect()
    assert sum(r["take"] for r in half) == total // 2
    assert mixing.mix(docs.limit(0)).count() == 0


# ---- neighbours


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 12)).astype(np.float32)
    x[50:80] = x[7]  # exact copies: ties
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)]
    rows += [(1000, None, 0), (1020, [0.0] * 12, 0), (1040, [float("nan")] + [1.0] * 11, 0), (1060, [None] + [1.0] * 11, 0), (None, [1.0] * 12, 0), (1080, [1.0], 0), rows[60]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = neighbours.search(df, block=64).collect()
    ids = np.arange(400)
    seen = {}
    for r in got:
        seen.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(seen) == set(range(0, 400, 20))
    hit = 0
    for q, found in seen.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21))
        score = np.cumsum(x.astype(float) * x[q].astype(float), axis=1)[:, -1]
        assert all(abs(s - score[v]) < 1e-12 for _, v, s in found)
        assert found == sorted(found, key=lambda f: (-f[2], f[1]))
        hit += len({v for _, v, _ in found} & {i for i in np.lexsort((ids, -score)) if i != q and True} & set([i for i in np.lexsort((ids, -score)) if i != q][:20]))
    assert hit >= 0.9 * 20 * len(seen)
    assert neighbours.search(df.limit(0)).count() == 0
    assert neighbours.search(df.where("vec_id IN (0, 1, 2)"), probes=24).count() == 2


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(1).normal(size=(5, 16))
    assert np.allclose(np.linalg.norm(neighbours.hadamard(x), axis=1), np.linalg.norm(x, axis=1))
    assert np.allclose(neighbours.hadamard(neighbours.hadamard(x)), x)


# ---- URLs


def test_urls(spark):
    urls = [
        None, "", "no-scheme.org/x", "http://A.example.ORG/es/1?x#y", "http://example.org/en/12", "http://org/", "http://xorg/", "http://foo.com#/fr/", "http://foo.com/fr/://x.org/",
        "https://www.casino-win.example.net/a", "http://a.org?q=/", "http://x.com/" + "de/" * 20_000, "ftp://de.com/de/x", "http://evil.net/x.org/", "x\ny://b.org/\nz",
    ]
    df = spark.createDataFrame([(i, u, "", "k") for i, u in enumerate(urls)] + [(3, urls[3], "", "k")], "page_id long, url string, html string, host string")
    got = by_id(url_filter.judge(df), "page_id")
    assert len(got) == len(urls) + 1

    def want(u):
        m = re.search(r"://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].translate(str.maketrans(common.CAPITALS, common.SMALL)), m[2]) if m else ("", "")
        fits = [r for r in url_filter.RULES if host and (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.text), default=None)
        method = "block" if any(r.host.strip("*") in host for r in url_filter.METHOD) else "allow"
        return host, path, best and best.text, best.verdict if best else method

    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == want(urls[r["page_id"]])
    assert url_filter.judge(df.limit(0)).count() == 0


def test_automaton_over_many_words():
    rules = [url_filter.Rule("block", f"h{i}.*.test{i}", f"/p{i}*q") for i in range(40)]
    machine = url_filter.Automaton(rules)
    assert machine.words > 8
    found = machine.fits([url_filter.canonical("a.h7.b.c.test7", "/p7zzq1"), url_filter.canonical("h39.x.test39", "/p39q"), url_filter.canonical("h3.test3", "/p3q"), b""])
    assert [list(np.flatnonzero(r)) for r in found] == [[7], [39], [], []]


# ---- token files


def test_token_files_round_trip(spark, docs, tmp_path):
    path = str(tmp_path / "shards")
    token_files.write(docs, path, shard=2_000)
    shards = token_files.read(spark, path)
    got = sorted((r.asDict() for r in token_files.documents_in(shards).collect()), key=lambda r: r["start"])
    coder = token_files.encoder(token_files.default_tokenizer()).tokenizer
    start, everything = 0, []
    for r, (d, t) in zip(got, sorted(TEXTS, key=lambda x: (x[0] is not None, x[0] or 0))):
        ids = [*coder.encode(t or "", add_special_tokens=False).ids, 2]
        assert r == {"doc_id": d, "start": start, "n_tokens": len(ids), "ids_crc32": zlib.crc32(np.array(ids, "<u4").tobytes())}
        start, everything = start + len(ids), everything + ids
    assert len(got) == len(TEXTS) and shards.count() > 1
    token = everything[3]
    assert sorted(r.place for r in token_files.occurrences(shards, token).collect()) == [i for i, x in enumerate(everything) if x == token]
    assert {r.token: r.n for r in token_files.token_counts(shards, [token, 2]).collect()} == {token: everything.count(token), 2: everything.count(2)}
    token_files.write(docs.limit(0), str(tmp_path / "none"))
    assert token_files.documents_in(token_files.read(spark, str(tmp_path / "none"))).count() == 0


def test_wavelet_matrix_answers():
    ids = np.random.default_rng(5).integers(0, 1000, 5000).astype(np.uint16)
    m = token_files.WaveletMatrix.from_bytes(token_files.WaveletMatrix.build(ids, 10).to_bytes())
    assert (m.decode() == ids).all()
    for at in (0, 17, 4999):
        assert m.access(at) == ids[at]
    for token in (0, 7, 999):
        assert m.rank(token, 2500) == (ids[:2500] == token).sum()
        assert (m.select(token) == np.flatnonzero(ids == token)).all()
    assert m.rank(5000) == 0 and len(m.select(5000)) == 0


def test_words_are_encoded_like_whole_texts():
    own = token_files.Encoder(token_files.default_tokenizer(), words=50)
    texts = ["", " ", "a  b", "x\n y", "it's we'll 12ab!?", "<|endoftext|> a", "漢字 é ñ", "a b c " * 30, "\x00 z", " lead", "trail "]
    for _ in range(2):
        assert [list(x) for x in own.encode(texts)] == [e.ids for e in own.tokenizer.encode_batch(texts, add_special_tokens=False)]


# ---- Jaccard join


def plain_join(rows, width, percent):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(str.maketrans(common.CAPITALS, common.SMALL)))
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    out = []
    for k, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[k] and rows[j][0] is not None]
        out.append((d is not None, d or 0, len(sets[k]), min(ids) if sets[k] and ids else d))
    return sorted(out, key=str)


def test_join_equals_brute_force(spark, docs):
    rng = np.random.default_rng(11)
    base = [" ".join(rng.choice(WORDS, n)) for n in (3, 12, 40, 40, 120, 300)]
    rows = list(TEXTS)
    for k in range(150):
        words = base[k % len(base)].split()
        for at in rng.integers(0, len(words), rng.integers(0, 5)):
            words[at] = str(rng.choice(WORDS))
        rows.append((100 + k, " ".join(words) + " PASSAGE that many texts have in common here".lower() * (k % 3 == 0)))
    df = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, n int")
    for width, percent, group in ((4, 85, 256), (5, 80, 8)):
        got = jaccard_join.join(df, width, percent, group=group).collect()
        assert sorted(((r.doc_id is not None, r.doc_id or 0, r.n_shingles, r.component_id) for r in got), key=str) == plain_join(rows, width, percent)
    assert jaccard_join.join(docs.limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 102), (102, 100), (7, 7), (None, 3), (5, 5)] + [(200, 200 + i) for i in range(1, 50)]
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100, **{200 + i: 200 for i in range(50)}}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- passages


def test_repeated_passages(spark, docs):
    rng = np.random.default_rng(2)
    text = lambda n: " ".join(rng.choice(WORDS, n))
    passage, license_line = text(60), text(20)
    near = passage.split()
    near[30] = "other"
    rows = [(1, f"{text(80)} {passage} {text(30)}"), (2, f"{text(10)} {passage}"), (3, f"{text(200)} {license_line}"), (4, f"{license_line} {text(90)}"), (5, f"{' '.join(near)} {text(40)}"), (6, text(100)), (7, None), (8, ""), (9, passage), (9, passage)]
    got = substring_dedup.repeated(spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, cls int")).collect()
    spans = {}
    for r in got:
        spans.setdefault(r.doc_id, set()).add((r.start, r.end))
    assert set(spans) == {1, 2, 5, 9}
    for doc, (low, high) in {1: (80, 140), 2: (10, 70), 5: (0, 60), 9: (0, 60)}.items():
        (start, end), = spans[doc]
        assert abs(start - low) <= 2 and abs(end - high) <= 2
    assert sum(r.doc_id == 9 for r in got) == 2
    assert {r.doc_id for r in substring_dedup.repeated(docs).collect()} == {6, 7}
    assert substring_dedup.repeated(docs.limit(0)).count() == 0


def test_compact_windows_cover_every_passage_once():
    h = np.random.default_rng(4).integers(0, 60, 90).astype(np.uint64)
    windows = substring_dedup.compact_windows(h, 8)
    for a in range(len(h)):
        for b in range(a + 7, len(h)):
            least = h[a : b + 1].min()
            assert sum(v == least and low <= a and b <= high and (h[a : b + 1] == v).any() for v, low, _, high in windows) == 1


# ---- decontamination


def plain_hits(text, items):
    words = decontaminate.words_of(text)
    hit, found = set(), set()
    for item, t in items:
        own = decontaminate.words_of(t)
        for k in range(max(1, len(own) - 12) if own else 0):
            window = own[k : k + 13]
            for at in range(len(words) - len(window) + 1):
                if words[at : at + len(window)] == window:
                    hit.update(range(at, at + len(window)))
                    if item is not None:
                        found.add(item)
    names = ",".join(sorted(map(str, found)))
    return len(words), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words)


def test_contamination_equals_a_plain_search(spark, docs):
    item = " ".join(WORDS[:30])
    items = [(1, item), (2, "alpha, BETA gamma"), (10, item), (3, None), (4, "?!"), (None, "delta epsilon"), (2, "alpha, BETA gamma"), (5, "Zeta")]
    rows = [*TEXTS, (20, "x " * 300 + " ".join(WORDS[5:20])), (21, "Alpha-beta/gamma delta epsilonzeta"), (22, "y " + item.upper() + " " + item)]
    benchmark = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, d int")
    df = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, spans int")
    for limit in (64 << 20, 50):
        got = [(r.doc_id is not None, r.doc_id or 0, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.contamination(df, benchmark, block_bytes=limit).collect()]
        assert sorted(got) == sorted((d is not None, d or 0, *plain_hits(t, items)) for d, t in rows)
    kept = decontaminate.keep_clean(docs, benchmark)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, t in TEXTS if not plain_hits(t, items)[4]}
    assert decontaminate.contamination(df, benchmark.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contamination(df.limit(0), benchmark).count() == 0


# ---- pages


def test_pages(spark):
    page = "<html><head><title>t</title></head><body><nav><ul><li>menu</li></ul></nav>{}<footer>&copy; x</footer></body></html>"
    bodies = [
        "<article><h1>A &amp; B</h1><p>one\n  two<p>three <b>bold</b> tail</article>",
        "<aside>side</aside><article><div class='share-buttons'>no</div><p>x&nbsp;y</p><form>f</form><section id=comments><p>reader</p></section></article>",
        "<div class=\"cookie-notice\">n</div><main><p>m</p><script>var a='<p>';</script></main>",
        "<div><p>plain</p></div>", "<article><p>" + "long " * 50_000 + "</p></article>",
    ]
    want = ["A & B\none two\nthree bold tail", "x y", "m", "plain", ("long " * 50_000).strip()]
    rows = [(i, "http://h.org/" + str(i % 2), page.format(b), 0) for i, b in enumerate(bodies)] + [(90, None, None, 0), (91, "x", "", 0), (0, "http://h.org/0", page.format(bodies[0]), 0)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, host int")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.text == (want[r.page_id] if r.page_id < 5 else "") and r.n_chars == len(r.text)
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_a_template_ends_what_a_page_left_open():
    template = ["html", "body", "nav", "/nav", "article", "/article", "footer", "/footer"]
    broken = "<html><body><nav><ul><li>menu<article><p>text</article><footer>f</footer>"
    assert html_text.main_text(broken, template) == "text"


# ---- quality


def test_quality_small_cases(spark, docs):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 9)] + [(1, None, 0), (None, 1, 0)], "doc_id long, quality int, x int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == len(TEXTS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert all(0 <= r.score <= 1 for r in quality.classify(docs, labels.limit(0)).collect())
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_scores_are_those_of_the_densities():
    rng = np.random.default_rng(0)
    d = len(quality.FEATURES)
    x = [rng.normal(k, 1 + k, (300, d)) for k in (0, 1)]
    model = quality.solve([300.0, 300.0], [v.sum(axis=0) for v in x], [v.T @ v for v in x], 0.02, 0.5)
    assert (model.scores(x[1]) > 0.5).mean() > 0.95 and (model.scores(x[0]) < 0.5).mean() > 0.95


def test_a_full_token_filter_changes_no_result(spark, docs, monkeypatch):
    rows = spark.createDataFrame([(int(r),) for r in np.arange(5000) * 7919 % (1 << 40)], "r long")
    bits = jaccard_join.bits_of(rows)
    kept = np.array([r.r for r in rows.collect()])
    others = np.arange(1, 100_000) * 104_729 + (1 << 41)
    assert jaccard_join.may_hold(bits, kept).all() and jaccard_join.may_hold(bits, others).mean() < 0.15
    assert jaccard_join.may_hold(bits, np.array([jaccard_join._COLD])).all()
    plain = sorted(map(tuple, jaccard_join.join(docs).collect()), key=str)
    monkeypatch.setattr(jaccard_join, "FILTER", 8)
    assert len(jaccard_join.bits_of(rows)) == 1
    assert sorted(map(tuple, jaccard_join.join(docs).collect()), key=str) == plain


def test_texts_between_steps_of_the_join_are_packed_tightly(spark, monkeypatch):
    packed, write = {}, common.written

    def written(df, label, *codec):
        table = write(df, label, *codec)
        packed.setdefault(label, table.inputFiles())
        return table

    monkeypatch.setattr(common, "written", written)
    docs = spark.createDataFrame([(k, f"one two three four five {k}") for k in range(9)], "doc_id long, text string")
    assert jaccard_join.join(docs).count() == 9
    assert all(".zstd." in f for label in ("classes", "texts") for f in packed[label])
