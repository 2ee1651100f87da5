"""Whitening, exact top-k search and spelling variants against brute force, with the small cases."""

import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest
import re

from fleetscope.llm import ball_tree, common, spelling, whitening

NAN, INF = float("nan"), float("inf")
CLASHING = "vec_id long, embedding array<float>, id int, e string, n int, score int, word string"


def table(spark, vectors):
    return spark.createDataFrame([(i, v, 1, "x", 2, 3, "w") for i, v in vectors], CLASHING)


@pytest.fixture(scope="module")
def mixed(spark):
    """Repeated rows and ids, ties, vectors that take no part, a long hot group of equal vectors."""
    random = np.random.default_rng(3)
    rows = [(i, v.tolist()) for i, v in enumerate(random.normal(0, 0.3, (400, 12)).astype(np.float32))]
    rows += [(1000 + i, rows[20][1]) for i in range(300)] + [rows[0], rows[100], (100, rows[7][1]), (None, rows[5][1])]
    bad = [None, [], [1.0] * 11 + [None], [NAN] + [0.0] * 11, [INF] + [0.0] * 11, [0.5] * 11, [0.5] * 900]
    return rows, rows + [(2000 + 100 * i, v) for i, v in enumerate(bad)] + [(5000, [0.0] * 12)]


# ---- whitening


def test_bidiagonal_form_has_the_singular_values():
    random = np.random.default_rng(1)
    for x in (random.normal(size=(80, 9)) * 10.0 ** -np.arange(9), np.eye(6), np.ones((5, 4)), random.integers(0, 2, (30, 1)) * np.ones((1, 7)), np.zeros((3, 2))):

        class Local:
            def back(self, w, left):
                u = x @ w
                return x.T @ u, float(u @ u), (x @ left.T).T @ u

        dims = x.shape[1]
        right, small = whitening.bidiagonalise(Local(), dims, dims, 5)
        assert np.allclose(right @ right.T, np.eye(dims), atol=1e-12)
        assert np.allclose(small, np.triu(np.tril(small, 1)))
        want = np.zeros(dims)
        own = np.linalg.svd(x, compute_uv=False)
        want[: len(own)] = own
        assert np.allclose(np.linalg.svd(small, compute_uv=False), want, atol=1e-12 * max(want[0], 1))


def plain_whitening(x, k):
    n, total = len(x), x.sum(axis=0)
    c = (n * x - total) / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return c @ u / np.sqrt(e), e / np.trace(c.T @ c / n), ((n * x - total) ** 2).sum(axis=1)


def test_whitening_equals_an_eigen_decomposition(spark, mixed):
    rows, given = mixed
    rows = rows + [(5000, [0.0] * 12)]
    got = whitening.whiten(table(spark, given).repartition(3), components=8).toPandas()
    x = np.floor(64 * np.array([v for _, v in rows], np.float32).astype(float)).astype(np.int64)
    z, explained, deviation = plain_whitening(x + 1_000_000, 8)
    assert len(got) == 8 * len(rows) and (got["n"] == len(rows)).all() and got["identity_error"].nunique() == 1 and got["identity_error"].max() < 1e-9
    first = got[got["component"] == 1].reset_index(drop=True)
    by_id = lambda ids, values: sorted(zip([-1 if i != i or i is None else int(i) for i in ids], values))
    assert by_id(first["vec_id"], first["deviation"]) == by_id([i for i, _ in rows], deviation.tolist())
    for c in range(8):
        own = got[got["component"] == c + 1]
        assert np.allclose(own["explained"], explained[c], rtol=1e-10)
        # one sign for all rows
        sign = np.sign(own[own["vec_id"] == 1]["whitened"].iloc[0] * z[1, c])
        assert np.allclose(by_id(own["vec_id"], own["whitened"] * sign), by_id([i for i, _ in rows], z[:, c]), atol=1e-9)


def test_whitening_small_cases(spark):
    assert whitening.whiten(table(spark, [])).count() == 0
    assert whitening.whiten(table(spark, [(1, [0.5, 0.25])])).count() == 0
    assert whitening.whiten(table(spark, [(1, [0.5]), (2, [0.5]), (3, None)])).count() == 0
    # three rows have two directions, huge entries keep exact sums, and what is no long is null
    got = whitening.whiten(table(spark, [(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [0.0, 0.0, 1.0])])).collect()
    assert sorted((r.vec_id, r.component) for r in got) == sorted(product((1, 2, 3), (1, 2)))
    assert {r.deviation for r in got} == {128**2 + 2 * 64**2} and all(r.identity_error < 1e-9 for r in got)
    huge = whitening.whiten(table(spark, [(1, [1e30, 0.0]), (2, [-1e30, 0.0]), (3, [0.0, 1e9])])).collect()
    assert len(huge) == 6 - 3 * (len({r.component for r in huge}) == 1) and all(r.deviation is None for r in huge if r.vec_id < 3)
    assert whitening.squares(np.array([[2**40, 1], [2**31, 0]], object)) == [None, 2**62]


# ---- exact top-k


def plain_top(rows, every, k, scale=1024):
    y = {}
    for i, v in rows:
        if i is not None:
            y.setdefault(i, []).append([int(c) for c in np.floor(scale * np.array(v, np.float32).astype(float))])
    out = []
    for q in (i for i in y if i % every == 0):
        scores = {c: max(sum(a * b for a, b in zip(u, w)) for u in y[q] for w in y[c]) for c in y if c != q}
        out += [(q, r + 1, c, s) for r, (c, s) in enumerate(sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k])]
    return sorted(out)


@pytest.mark.parametrize("shard, block", [(100, 3), (10_000, 1000), (30, 1)])
def test_top_k_equals_a_plain_search(spark, mixed, shard, block):
    rows, given = mixed
    got = ball_tree.top_k(table(spark, given).repartition(3), every=100, k=10, shard=shard, leaf=8, block=block, most_cells=5)
    assert sorted(map(tuple, got.collect())) == plain_top(rows + [(5000, [0.0] * 12)], 100, 10)


def test_trees_and_blocks_do_not_go_over_the_driver(spark, mixed):
    """A block for each shard was once made before the join, where Spark saw the size of the blocks alone and broadcast all."""
    _, given = mixed
    got = ball_tree.top_k(table(spark, given).repartition(3), every=2, k=10, shard=30, leaf=8, block=40, most_cells=5)
    assert got.count() and len(got.collect()) > 1000
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and not re.search(r"BroadcastExchange|BroadcastNestedLoopJoin", plan)


def test_top_k_small_cases(spark):
    assert ball_tree.top_k(table(spark, [])).count() == 0
    assert ball_tree.top_k(table(spark, [(0, [1.0]), (0, [2.0]), (None, [3.0])])).count() == 0
    few = [(0, [1.0, 0.0]), (1, [0.5, 0.0]), (2, [0.5, 1.0]), (3, [-1.0, 0.0])]
    assert sorted(map(tuple, ball_tree.top_k(table(spark, few)).collect())) == plain_top(few, 100, 10)
    large = [(0, [1e6, 1e6]), (1, [1e6, 1.0]), (2, [1e6, 1.0009765625]), (100, [3e18, 1.0])]
    got = {(r.query_id, r.vec_id): r.score for r in ball_tree.top_k(table(spark, large)).collect()}
    assert got[0, 2] - got[0, 1] == 1024_000_000 and got[0, 100] == 2**63 - 1


def test_a_tree_opens_few_leaves():
    """Far groups are not opened once near rows were found."""
    random = np.random.default_rng(2)
    rows = np.floor(np.concatenate([random.normal(0, 5, (500, 6)) + 1000 * d for d in np.eye(6)]))
    tree = ball_tree.BallTree.build(np.arange(len(rows)), rows, 16)
    for node, (low, high, child) in enumerate(tree.nodes):
        assert np.linalg.norm(tree.rows[low:high] - tree.centre[node], axis=1).max() <= tree.radius[node] + 1e-9
        assert child < 0 or (tree.nodes[child][0], tree.nodes[child][1], tree.nodes[child + 1][1]) == (low, tree.nodes[child + 1][0], high)
    seen = []
    tree.ids = type("Ids", (), {"__getitem__": lambda self, at: seen.append(at) or np.arange(3000)[at]})()
    list(tree.search(rows[:1], np.array([-1]), np.array([-(1 << 63)]), 5))
    assert 0 < len(seen) < 0.2 * (tree.nodes[:, 2] < 0).sum() * 2


# ---- spelling


def plain_words(docs, least=5, times=3, every=97):
    count = Counter()
    for d, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(str.maketrans(common.CAPITALS, common.SMALL))
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            count[run[: h % len(run)] + run[h % len(run) + 1 :] if h % every == 0 else run] += 1
    return {w: n for w, n in count.items() if len(w) >= least and n >= times}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_groups(words):
    form, out = {}, []
    near = {w: [v for v in words if one_apart(v, w)] for w in words}
    for w in words:
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words.get(form[w])))
    return sorted(out)


@pytest.fixture(scope="module")
def texts():
    random = np.random.default_rng(4)
    stems = ["house", "housés", "mansion", "Àstone", "aaaaaa", "ÿfield", "banana"]
    docs = []
    for d in range(150):
        words = []
        for _ in range(60):
            w = stems[int(random.integers(len(stems)) * random.random())]
            for _ in range(int(random.integers(3)) if random.random() < 0.5 else 0):
                i, c = int(random.integers(len(w))), "aeoéz"[int(random.integers(5))]
                w = [w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :]][int(random.integers(3))]
            words.append(w.upper() if random.random() < 0.1 else w)
        docs.append((d, "-".join(words)))
    docs += [(None, "Houses houses HOUSES ×÷×÷× ābcdefg"), (1, None), (2, ""), (3, "ab " * 50 + "zzzzz" * 4000 + " " + ("zzzzz" * 4000 + " ") * 2)]
    return docs + [docs[0]] * 3


def test_vocabulary_and_groups_equal_plain_ones(spark, texts):
    df = spark.createDataFrame([(d, t, "w", 1, "o") for d, t in texts], "doc_id long, text string, word string, n int, other string").repartition(3)
    words = plain_words(texts)
    assert {r.word: r.n for r in spelling.vocabulary(df).collect()} == words and len(words) > 100
    want = plain_groups(words)
    assert sum(r[1] is not None and r[2] != r[1] for r in want) > 3
    assert sorted(map(tuple, spelling.group(df).collect())) == want
    # a filter of one block lets nearly all through, and the join removes it
    assert sorted(map(tuple, spelling.group(df, most_bytes=64).collect())) == want


def test_spelling_small_cases(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.group(empty).count() == 0
    rare = spark.createDataFrame([(1, "abcde abcde"), (2, "tiny tiny tiny tiny")], "doc_id long, text string")
    assert spelling.group(rare).count() == 0


def test_every_edit_is_hashed_as_the_edited_word():
    word = "bébbea"
    letters = np.frombuffer(word.encode("latin-1"), np.uint8)[None]
    numbers = spelling._numbers(len(word))
    for i, h in enumerate(spelling.deletions(letters, numbers)[0]):
        rest = np.frombuffer((word[:i] + word[i + 1 :]).encode("latin-1"), np.uint8)[None]
        assert spelling.hashes(rest, spelling._numbers(len(word) - 1))[0] == h


def test_filters_hold_all_and_little_else():
    random = np.random.default_rng(0)
    filters = spelling.Filters({6: 5000, 7: 100}, 16, 1 << 20)
    inside, outside = random.integers(0, 2**63, 5000).astype(np.uint64), random.integers(0, 2**63, 20000).astype(np.uint64)
    slot, mask = filters.bits(inside, 6)
    np.bitwise_or.at(filters.blocks.reshape(-1), slot, mask)
    assert len(filters.hits(inside, 6)) == 5000 and len(filters.hits(outside, 6)) < 100 and not len(filters.hits(inside, 5)) and len(filters.hits(inside, 7)) < 50


# ---- approximate neighbours, over the same rows


def test_neighbours_of_batches_without_a_valid_vector(spark):
    rows = [(i, None) for i in range(40)] + [(100, [1.0, 0.0]), (101, [0.5, 0.5]), (120, [0.0, 0.0]), (140, [1.0] * 9)]
    from fleetscope.llm import neighbours

    got = neighbours.search(table(spark, rows).repartitionByRange(4, "vec_id"), every=20)
    assert [(r.query_id, r.vec_id, r.score) for r in got.collect()] == [(100, 101, 0.5)]
    assert neighbours.search(table(spark, [(0, None), (1, [NAN])])).count() == 0


def test_remembered_words_are_bounded_and_encoded_alike():
    from fleetscope.llm import token_files

    small, large = (token_files.Encoder(token_files.default_tokenizer(), most_bytes=n) for n in (20_000, 1 << 30))
    texts = [" ".join(f"word{i * j % 97}x common, the{j}" for i in range(60)) for j in range(60)]
    for at in range(0, 60, 5):
        one, two = small.encode(texts[at : at + 5]), large.encode(texts[at : at + 5])
        assert [o.tolist() for o in one] == [t.tolist() for t in two] == [small.tokenizer.encode(t, add_special_tokens=False).ids for t in texts[at : at + 5]]
        assert len(small.known) + len(small.elder[0]) < 600
