"""MinHash near-duplicate removal: one-permutation hashing, optimal densification, banded buckets, star-shaped candidate edges.

One hash of each shingle serves all bins: its high bits choose the bin, and the smallest hash of a bin is the bin's value. An empty bin takes
the value of a full one, found by probing bins in an order that depends on the empty bin alone, so two sets agree in any bin, full or
empty, with the probability of their similarity. ROWS bins in a row make the key of a bucket, BANDS of them a text's buckets: two texts at
80 per cent meet in none of them with a probability of (1 - 0.8 ** 5) ** 50, about 2e-9.

Texts of equal sets are one class. The pairs of a bucket are not listed: each bucket is a star, with edges from its smallest class to the
others, and stars of one centre are one star. Every edge is confirmed on the two full sets. What a star cannot settle is a link between two
of its leaves. By the triangle inequality of Jaccard distance, a leaf that stayed outside the centre's component can be linked only with other
outside leaves and with inside ones that are at most so much nearer to the centre; those leaves form the next round's stars. After ROUNDS
rounds the leaves that still aren't settled are gathered into components of candidates, in which all overlaps are counted exactly, in pairs of
blocks where they are large. So nothing that shares a bucket is lost, and a group of m near copies costs about m edges a round.

Texts are shuffled once, sets only for classes that share a bucket with another class; a class of many copies is collapsed before a shuffle.

Cases: a null text, or one without words, has an empty set, which is linked with nothing; fewer words than a shingle make one shingle;
repeated rows and ids are members each; a null id can't name a component and is kept only where none of its component has an id; extra
columns are ignored; an empty table gives an empty table. Sets are compared by 64-bit hashes of their shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelweave.llm.common import components, give_back, lookup, materialize, mix, pack, utf8_column
from voxelweave.llm.jaccard_join import SLICE, class_ids, row_key, shingle_sets, slices, told_apart, verified

BANDS, ROWS = 50, 5
#: Star rounds before the rest is verified by components.
ROUNDS = 2
#: Texts whose bins are held at once.
TEXTS = 4096


def sketches(t: np.ndarray, h: np.ndarray, n: int, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Bins of the texts 0..n-1, and which texts have any, from their (text, hash) sorted."""
    held = np.zeros((n, bins), np.uint64)
    full = np.zeros((n, bins), bool)
    if len(t):
        at = (((h >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)).astype(np.int64)
        first = np.ones(len(t), bool)
        first[1:] = (t[1:] != t[:-1]) | (at[1:] != at[:-1])
        held[t[first], at[first]], full[t[first], at[first]] = h[first], True
    some = full.any(1)
    rows, empty = np.nonzero(~full & some[:, None])
    out = held.copy()
    columns, tries = np.arange(bins, dtype=np.uint64), 0
    while len(rows):
        if tries < 8 * bins:
            probe = (mix(columns * np.uint64(0x9E3779B97F4A7C15) + np.uint64(tries + 1)) % np.uint64(bins)).astype(np.int64)[empty]
        else:  # about one bin in a thousand of a set with one bin: the next full one
            probe = (empty + tries - 8 * bins + 1) % bins
        hit = full[rows, probe]
        out[rows[hit], empty[hit]] = held[rows[hit], probe[hit]]
        rows, empty, tries = rows[~hit], empty[~hit], tries + 1
    return out, some


def bucket_keys(t: np.ndarray, h: np.ndarray, n: int, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the buckets, a row for each text that has a set, and which texts have."""
    values, some = sketches(t, h, n, bands * rows)
    folded = values[some].reshape(-1, bands, rows)
    keys = np.zeros(folded.shape[:2], np.uint64)
    for i in range(rows):
        keys = mix(keys + folded[:, :, i])
    return mix(keys + np.arange(1, bands + 1, dtype=np.uint64)[None, :]).view(np.int64), some


def features(docs: DataFrame, width: int, percent: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, n_shingles, cls, digest, mark, keys) of every row of (doc_id, text, mark). Sets too small to be linked with any other set
    have no keys."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8_column(batch.column(1))
            for a, b in slices(offsets, SLICE):
                t, h = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width)
                counts, ids, digests = class_ids(t, h, b - a)
                fit = 100 * counts >= percent * (counts + 1)
                for lo in range(0, b - a, TEXTS):
                    hi = min(lo + TEXTS, b - a)
                    mine = slice(*np.searchsorted(t, [lo, hi]))
                    keep = fit[t[mine]]
                    keys, some = bucket_keys(t[mine][keep] - lo, h[mine][keep], hi - lo, bands, rows)
                    ends = np.concatenate([[0], np.cumsum(some * bands)]).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.reshape(-1)))
                    own = [batch.column(c).slice(a + lo, hi - lo) for c in (0, 2)]
                    yield pa.RecordBatch.from_arrays([own[0], *(pa.array(x[lo:hi].astype(np.int64)) for x in (counts, ids, digests)), own[1], lists], names=["doc_id", "n_shingles", "cls", "digest", "mark", "keys"])
            give_back()

    return docs.mapInArrow(run, "doc_id long, n_shingles long, cls long, digest long, mark long, keys array<long>")


def stars(members: DataFrame) -> DataFrame:
    """(c, x, nc, nx): distinct edges from the smallest class of a bucket to the others, from (cls, n, keys)."""
    held = members.select("cls", "n", F.explode("keys").alias("key"))
    buckets = held.groupBy("key").agg(F.min(F.struct("cls", "n")).alias("m"), F.count("*").alias("_n")).where("_n > 1")
    buckets = materialize(buckets.select("key", F.col("m.cls").alias("c"), F.col("m.n").alias("nc"), "_n"), "buckets")
    total = max(1, members.count() * BANDS)
    found = lookup(held, buckets.withColumnRenamed("key", "k"), "key", "k", total).where("c <> cls")
    return found.select("c", F.col("cls").alias("x"), "nc", F.col("n").alias("nx")).distinct()


def sets_of(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(cls, tokens) of each class of wanted (cls, rep), from the row that rep names. Rows that repeat it come together after the join, and
    all but the first in a task are left out."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            data, offsets = utf8_column(batch.column(1))
            cls = batch.column(0).to_numpy()
            for a, b in slices(offsets, SLICE):
                t, h = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width)
                new = np.ones(b - a, bool)
                new[1:] = cls[a + 1 : b] != cls[a : b - 1]
                new[0] = last is None or cls[a] != last
                last = cls[b - 1]
                keep = new[t]
                ends = np.concatenate([[0], np.cumsum(np.bincount(t[keep], minlength=b - a)[new])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(cls[a:b][new]), pa.ListArray.from_arrays(pa.array(ends), pa.array(h[keep].view(np.int64)))], names=["cls", "tokens"])
            give_back()

    left = docs.select(F.coalesce("doc_id", F.lit(0).cast("long")).alias("_d"), "mark", "text")
    right = wanted.select("cls", F.col("rep.doc_id").alias("_d"), F.col("rep.mark").alias("mark"))
    return left.join(right.hint("merge"), ["_d", "mark"]).select("cls", "text").mapInArrow(run, "cls long, tokens array<long>")


def confirmed(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """edges with linked, and bounds of their similarity: exact where the sizes allow a link and the sets were compared."""
    fits = 100 * F.least("nc", "nx") >= percent * F.greatest("nc", "nx")
    pairs = edges.where(fits).select("c", "x")
    pairs = pairs.join(sets.select(F.col("cls").alias("x"), F.col("tokens").alias("tx")), "x").join(sets.select(F.col("cls").alias("c"), F.col("tokens").alias("tc")), "c")
    both = pairs.select("c", "x", F.size(F.array_intersect("tc", "tx")).cast("long").alias("both"))
    out = edges.join(both, ["c", "x"], "left")
    similar = F.col("both") / (F.col("nc") + F.col("nx") - F.col("both"))
    linked = F.coalesce(100 * F.col("both") >= percent * (F.col("nc") + F.col("nx") - F.col("both")), F.lit(False))
    return out.select("c", "x", "nc", "nx", linked.alias("linked"), F.coalesce(similar, F.lit(0.0)).alias("low"), F.coalesce(similar, F.least("nc", "nx") / F.greatest("nc", "nx")).alias("high")).distinct()  # a set that was split over tasks is there twice


def unsettled(edges: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Edges of the next round: of each star the leaves that may yet be linked across the components (node, root), hung on the smallest."""
    root = lambda df, of, name: df.join(roots.select(F.col("node").alias(of), F.col("root").alias(name)), of, "left").withColumn(name, F.coalesce(name, of))
    seen = root(root(edges, "c", "rc"), "x", "rx").withColumn("outside", F.col("rc") != F.col("rx"))
    # what is summed by centre is written first: a join right behind an aggregate could not split a star of many leaves
    seen = materialize(seen, "seen")
    far = materialize(seen.where("outside").groupBy("c").agg(F.max("high").alias("far")), "far")
    slack = (100 - percent) / 100 + 1e-9
    left = materialize(seen.join(far, "c").where(F.col("outside") | (F.col("low") <= F.col("far") + slack)).select("c", "x", "nx"), "unsettled")
    least = materialize(left.groupBy("c").agg(F.min(F.struct("x", "nx")).alias("m")), "least")
    again = left.join(least, "c").select(F.col("m.x").alias("c"), "x", F.col("m.nx").alias("nc"), "nx")
    return again.where("c <> x").distinct()


def _packed(sets: DataFrame) -> DataFrame:
    """sets as verified() reads them."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cls, tokens in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = tokens.values.to_numpy().view(np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.array([cls]), pa.array([len(own)]), pa.array([pack(np.sort(own))], pa.binary())], names=["kind", "id", "n", "keys"])

    return sets.mapInArrow(run, "kind int, id long, n long, keys binary")


def links(docs: DataFrame, members: DataFrame, width: int, percent: int, rounds: int = ROUNDS) -> DataFrame:
    """(node, root): components of the confirmed links between classes."""
    edges = materialize(stars(members.select("cls", "n", "keys")), "stars")
    wanted = edges.select(F.col("c").alias("cls")).unionByName(edges.select(F.col("x").alias("cls"))).distinct()
    sets = materialize(sets_of(docs, members.select("cls", "rep").join(wanted, "cls"), width), "star-sets")
    found, roots = None, None
    for _ in range(rounds):
        known = materialize(confirmed(edges, sets, percent), "confirmed")
        new = known.where("linked").select(F.col("x").alias("a"), F.col("c").alias("b"))
        if found is not None:
            new = new.unionByName(found)
        roots = components(new)
        found = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
        edges = materialize(unsettled(known, roots, percent), "next-stars")
        if not edges.limit(1).count():
            return roots
    groups = components(edges.select(F.col("x").alias("a"), F.col("c").alias("b")))
    rest = materialize(verified(_packed(sets.dropDuplicates(["cls"])), groups, percent), "rest-links")
    return components(found.unionByName(rest))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 75, text: str = "text", key: str = "doc_id", bands: int = BANDS, rows: int = ROWS, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row: component_id is the smallest doc_id that confirmed links reach, and its
    document is the one kept. bands and rows set the chance that a linked pair shares no bucket."""
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("mark", F.xxhash64("text"))
    feats = materialize(features(docs, width, percent, bands, rows), "features")
    total = feats.count()
    sizes = [F.min("digest") != F.max("digest"), F.min("n_shingles") != F.max("n_shingles")]
    group = lambda df: materialize(df.where("cls <> 0").groupBy("cls").agg(F.min("doc_id").alias("least"), F.count("*").alias("_n"), F.min("n_shingles").alias("n"), F.min(row_key()).alias("rep"), (sizes[0] | sizes[1]).alias("several"), F.first("keys").alias("keys")), "classes")
    members = group(feats)
    taken = np.sort(np.array([r.cls for r in members.where("several").select("cls").collect()], np.int64))  # of 63 bits: none, or very few
    if len(taken):
        feats = told_apart(feats, taken)
        members = group(feats)
    roots = links(docs, members, width, percent, rounds)
    rooted = members.select("cls", "least", "_n").join(roots, F.col("cls") == F.col("node"), "left").select("cls", "least", F.col("_n").alias("_rows"), F.coalesce("root", "cls").alias("root"))
    rooted = materialize(rooted, "rooted")
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("_n")).withColumnRenamed("root", "r")
    named = materialize(lookup(rooted, names, "root", "r", total), "named").where("_rows > 1 OR component_id <> least OR least IS NULL")
    out = lookup(feats.select("doc_id", "n_shingles", "cls"), named.select(F.col("cls").alias("c"), "component_id", F.col("_rows").alias("_n")), "cls", "c", total)
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
