"""MinHash near-duplicates, sort-means and fill-in-middle against brute force: nulls, empty and very long texts, ties, repeated rows, empty
tables, extra columns with the operators' own names."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelweave.llm import centroids, fill_middle, minhash
from voxelweave.llm.jaccard_join import shingle_sets

DOCS = "doc_id long, text string, n long, form string, keys string, cls long, output string"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, 7, "x", "k", 3, "o") for i, t in texts], DOCS).repartition(3)


def words(rng, n, vocabulary=5000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def set_of(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def linked_brute_force(texts, width, percent):
    """doc_id -> smallest id reachable, over all pairs."""
    sets = [set_of(t, width) for _, t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, (doc, _) in enumerate(texts):
        if doc is not None:
            least[root(i)].append(doc)
    return [(doc, len(sets[i]), min(least[root(i)], default=None)) for i, (doc, _) in enumerate(texts)]


def near_corpus():
    rng = random.Random(5)
    out = [(1, None), (2, ""), (3, " \n "), (4, "one two"), (5, "ONE two"), (6, "a b c d e f g h"), (7, "a b c d e f g h i"), (None, "lonely text without a number"), (8, "x " * 5000)]
    for g in range(12):  # chains of copies: neighbours are linked, the ends are not
        at = words(rng, rng.randrange(60, 200))
        for k in range(9):
            out.append((100 + 20 * g + k, " ".join(at)))
            at = list(at)
            for p in rng.sample(range(len(at)), 1 + len(at) // 70):
                at[p] = f"n{rng.randrange(10**6)}"
    base = words(rng, 300)
    out += [(None, " ".join(base)), (900, " ".join(base)), (900, " ".join(base)), (901, " ".join(base).upper())]
    shared = words(rng, 80)  # a common passage that links nothing
    out += [(1000 + i, " ".join(words(rng, 60) + shared + words(rng, 60))) for i in range(30)]
    return out


@pytest.mark.parametrize("rounds", [1, 2])
def test_near_duplicates_equal_all_pairs(spark, rounds):
    texts = near_corpus()
    out = minhash.near_duplicates(frame(spark, texts), width=4, percent=80, rounds=rounds)
    key = lambda r: tuple(-1 if x is None else x for x in r)
    got = out.collect()
    assert sorted((key(r[:3]) for r in got)) == sorted(key(r) for r in linked_brute_force(texts, 4, 80))
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert minhash.near_duplicates(frame(spark, []), width=4, percent=80).count() == 0


def test_bins_agree_with_the_probability_of_similarity():
    rng = random.Random(9)
    for n in (5, 40, 2000):
        hits = []
        for _ in range(30):
            own = [f"s{rng.randrange(10**9)}" for _ in range(n + n // 4)]
            texts = [" ".join(own[:n]), " ".join(own[n // 4 :])]  # sets of single words, 60 per cent alike
            data = "".join(texts).encode()
            t, h = shingle_sets(np.frombuffer(data, np.uint8), np.array([0, len(texts[0]), len(data)]), 1)
            values, some = minhash.sketches(t, h, 2, 250)
            assert some.all() and set(values[0]) <= set(h[t == 0])
            both = len(set(h[t == 0]) & set(h[t == 1])) / len(set(h))
            hits.append((values[0] == values[1]).mean() - both)
        assert abs(np.mean(hits)) < 0.04
    assert not minhash.sketches(np.zeros(0, np.int64), np.zeros(0, np.uint64), 3, 10)[1].any()
    one = minhash.sketches(np.zeros(1, np.int64), np.array([77], np.uint64), 1, 250)[0]
    assert (one == 77).all()


def test_star_edges_are_linear_in_a_group(spark):
    rng = random.Random(2)
    base = words(rng, 200)
    texts = []
    for i in range(120):
        own = list(base)
        own[rng.randrange(200)] = f"n{i}"
        texts.append((i, " ".join(own)))
    docs = frame(spark, texts).select("doc_id", "text").withColumn("mark", F.xxhash64("text"))
    feats = minhash.features(docs, 4, 80, 50, 5)
    edges = minhash.stars(feats.select("cls", F.col("n_shingles").alias("n"), "keys"))
    assert edges.count() < 6 * 120


def means_brute_force(rows, k, rounds, scale, width):
    import math

    kept = [(i, tuple(math.floor(scale * x) for x in v)) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)[:k]
    centres = [list(v) for _, v in start]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for r in range(rounds + 1):
        own = [min((gap(v, c), n) for n, c in enumerate(centres)) for _, v in kept]
        if r < rounds:
            for n in range(len(centres)):
                mine = [v for (_, v), (_, at) in zip(kept, own, strict=True) if at == n]
                if mine:
                    centres[n] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    inertia = defaultdict(int)
    for d, n in own:
        inertia[n] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return [(i, n, d, inertia[n], sum(inertia.values()), sha[n]) for (i, _), (d, n) in zip(kept, own, strict=True)]


def test_sort_means_equals_brute_force(spark):
    rng = random.Random(4)
    middle = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, [x + rng.gauss(0, 0.1) for x in rng.choice(middle)]) for i in range(200)]
    rows += [(500 + i, [0.25] * 6) for i in range(60)] + [(7, rows[7][1]), (7, [0.0] * 6), (None, [0.5] * 6)]
    rows += [(600, None), (601, []), (602, [1.0] * 5), (603, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (604, [float("nan")] * 6), (605, [float("inf")] * 6), (606, [-float("inf")] * 6)]
    table = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, cluster long, v long").repartition(4)
    key = lambda r: tuple(-1 if x is None else x for x in r)
    for k, rounds in ((8, 3), (1, 2), (4, 0), (500, 1)):
        got = centroids.sort_means(table, k=k, rounds=rounds, scale=64, width=6).drop("centroid").collect()
        assert sorted(map(key, got)) == sorted(map(key, means_brute_force(rows, k, rounds, 64, 6)))
    assert centroids.sort_means(table.where("vec_id > 599"), width=6).count() == 0
    huge = spark.createDataFrame([(1, [1e300] * 6), (2, [1.0] * 6)], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in centroids.sort_means(huge, width=6).collect()] == [2]


def test_scan_skips_distances_and_keeps_ties():
    rng = np.random.default_rng(1)
    near = rng.integers(0, 20, (12, 8)) + 1000 * np.arange(12)[:, None]
    x = np.repeat(near, 50, 0) + rng.integers(-3, 4, (600, 8))
    best, dist, worked = centroids.nearest(x, np.repeat(np.arange(12), 50), near)
    full = ((x[:, None] - near[None]) ** 2).sum(2)
    assert (best == full.argmin(1)).all() and (dist == full.min(1)).all() and worked == 600  # none but the first
    cold = centroids.nearest(x, np.zeros(600, np.int64), near)
    assert (cold[0] == full.argmin(1)).all() and cold[2] <= 600 * 12
    line = np.array([[4], [0], [4]])  # from number 2, number 0 at the same place ties; from 1, both are at exactly twice the distance
    assert centroids.nearest(np.array([[5], [2], [2]]), np.array([2, 1, 2]), line)[0].tolist() == [0, 0, 0]


UNIT = r"[A-Za-z]+|[^A-Za-z]"


def cut(doc, text, sentinels=("<P>", "<S>", "<M>"), unit=UNIT):
    text = text or ""
    u = re.findall(unit, text)
    n = len(u)
    digest = hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    x, y, z = ("".join(p) for p in (u[:a], u[a:b], u[b:]))
    p, s, m = sentinels
    if not text or any(t in text for t in sentinels) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    return (n, "spm", len(x), len(y), s + z + p + x + m + y) if h[3] % 100 < 20 else (n, "psm", len(x), len(y), p + x + s + z + m + y)


def cut_corpus():
    rng = random.Random(8)
    kinds = ["word", " ", "\n", "é", "日", "😀", "a", "Zz", "<", ">", "<P", "S>", "\0", "9", "\r\n", "́"]
    out = [(1, None), (2, ""), (3, " "), (4, "a"), (5, "😀" * 3001), (6, "a" * 5000), (7, "ab " * 400_000), (None, "no number here"), (8, "has <M> inside"), (9, "😀a" * 2500), (9, "the same id"), (9, "the same id")]
    return out + [(20 + i, "".join(rng.choice(kinds) for _ in range(rng.randrange(1, 4000)))) for i in range(120)]


def test_fill_in_middle_equals_brute_force(spark):
    texts = cut_corpus()
    out = fill_middle.transform(frame(spark, texts)).withColumn("back", fill_middle.restored(F.col("output"), F.col("form")))
    assert set(out.columns) == {"doc_id", "text", "n", "form", "keys", "cls", "output", "prefix_chars", "middle_chars", "back"}
    got = out.collect()
    key = lambda r: tuple("" if x is None else str(x) for x in r)
    assert sorted(key((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output)) for r in got) == sorted(key((i, *cut(i, t))) for i, t in texts)
    assert all(r.back == (r.text or "") for r in got)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    digests = fill_middle.digests(out.drop("back"))
    assert all(r.restored_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest() for r in digests.collect())
    assert fill_middle.transform(frame(spark, [])).count() == 0


@pytest.mark.parametrize(("grammar", "unit"), [("char", r"[\s\S]"), ("line", r"[^\n]*\n|[^\n]+"), ("led_word", r" ?[A-Za-z]+|[\s\S]")])
def test_unit_grammars(spark, grammar, unit):
    texts = [(i, t) for i, t in cut_corpus() if t is None or len(t) < 5000]
    texts += [(300, "\n\n a\nbc"), (301, "\n" * 1500), (302, "line " * 300 + "\n" + "x" * 2500)]
    got = fill_middle.transform(frame(spark, texts), grammar=grammar, sentinels=("\x01p", "\x02s", "\x03m")).collect()
    want = [(i, *cut(i, t, ("\x01p", "\x02s", "\x03m"), unit)) for i, t in texts]
    key = lambda r: tuple("" if x is None else str(x) for x in r)
    assert sorted(key((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output)) for r in got) == sorted(map(key, want))
    pieces = spark.createDataFrame(texts, "doc_id long, text string").select("text", fill_middle.units(F.coalesce("text", F.lit("")), fill_middle.boundary(fill_middle.GRAMMARS[grammar])).alias("u"))
    assert all(r.u == re.findall(unit, r.text or "") for r in pieces.collect())


def test_sentinels_that_a_cut_could_make(spark):
    for bad in (("<P>", "<P>", "<M>"), ("aa", "b", "c"), ("<P<", "<S>", "<M>"), ("", "b", "c")):
        with pytest.raises(ValueError, match="sentinels"):
            fill_middle.transform(frame(spark, []), sentinels=bad)
