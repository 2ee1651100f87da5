"""Every stage of the pipeline against a plain version."""

import hashlib
from collections import Counter

import corpus_pipeline
from fleetscope.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", "src0", len(t or "")) for d, t in rows], SCHEMA)


def words(tag, n):
    return " ".join(f"{tag}{k}" for k in range(n))


def counted(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def plain_groups(rows):
    """Union of all pairs at 80 % of five-word shingles; the smallest id stays, a null id only where there is no other."""
    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    sets, label = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    out = Counter()
    for g in set(label):
        own = [r for r, x in zip(rows, label) if x == g]
        ids = [d for d, _ in own if d is not None]
        out.update([r for r in own if r[0] == min(ids)] if ids else own[:1])
    return out


def test_near_duplicates_without_an_id(spark):
    a, b, c = words("a", 60), words("b", 60), words("c", 60)
    rows = [(None, a), (7, a + " tail"), (9, a), (None, b), (None, b), (3, c), (3, c), (None, None), (None, ""), (4, None), (None, words("d", 9))]
    assert counted(corpus_pipeline.keep_one_of_each_group(spark, frame(spark, rows), None)) == plain_groups(rows)


def test_mixture_keeps_rows_without_an_id(spark):
    rows = [(None, words("a", 40)), (None, words("b", 30)), (1, words("c", 20)), (1, words("c", 20)), (2, ""), (3, words("e", 90))]
    # one leaf: half of all tokens, in the order of the hash, whole documents
    left, want = sum(len(t.split()) for _, t in rows) // 2, Counter()
    for d, t in sorted((r for r in rows if r[1]), key=lambda r: (hashlib.md5(f"{mixing.SEED}:0:{'' if r[0] is None else r[0]}".encode()).digest(), len(r[1].split()))):
        if left > 0:
            want[(d, t)] += 1
            left -= len(t.split())
    got = counted(corpus_pipeline.take_mixture(spark, frame(spark, rows), None))
    assert got == want and sum(n for (d, _), n in want.items() if d is None)
