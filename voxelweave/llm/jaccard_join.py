"""N-gram Jaccard join with token-combination prefixes, and the components of its links.

A text's set holds the distinct shingles of so many lower-case words. Texts with equal sets are one class. Two classes link when the
intersection has at least the asked share of the union.

Tokens are ordered by how many classes hold them, rarest first; a token that a single class holds can link nothing, so only the
others are kept, while the first still count in set sizes and prefixes. With a the least overlap that a link needs, two linked sets
share k tokens within their first n - a + k. Sets of at least LONG tokens use k = GROUPS + 1: rare tokens of that prefix are index
keys of their own; the frequent ones fall into GROUPS groups by hash, and as k shared tokens leave two in one group, pairs of frequent
tokens of a group are the other keys. Smaller sets, and those that may link with smaller ones, use k = 1 and single tokens. Classes
that share a key are candidates; candidates are gathered into components, each set is sent once to its component, and there every
overlap that can join two parts is counted exactly. Components above BLOCK classes are cut into pairs of blocks, so a task holds at
most two blocks.

Cases: a null text, or one without words, has an empty set, which is linked with nothing; fewer words than a shingle make one
shingle; repeated rows and ids are classes' members each; a null id can't name a component; extra columns are ignored; an empty table
gives an empty table. Sets are compared by 64-bit hashes of their tokens; two sets are one class only if their sizes and two independent
digests are equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelweave.llm.common import components, give_back, lookup, materialize, mix, pack, runs, unpack, utf8_column

#: Groups of frequent tokens; prefixes are longer by as many tokens.
GROUPS = 16
#: Classes of one block of a candidate component.
BLOCK = 20_000
#: Bytes of text that are cut into words at once, and shingles that are sorted and sent at once.
SLICE, FLUSH = 1 << 19, 1_000_000
#: Bytes of a word up to which a polynomial modulo 2**64 has no strings made to collide; longer words are hashed by blake2b.
LONG_WORD = 256

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x9E3779B97F4A7C55
_UNBASE = pow(_BASE, -1, 1 << 64)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, SLICE + 1)
        _POWERS[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in (_BASE, _UNBASE)]
    return _POWERS


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every word of the texts data[offsets[i]:offsets[i + 1]], in order."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    word = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets[:-1]] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | edge[1:n]
    last = word.copy()
    last[:-1] &= ~word[1:] | edge[1:n]
    starts, ends = np.nonzero(first)[0], np.nonzero(last)[0] + 1
    up, down = _powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[_LOWER[data]] * up[:n], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    for i in np.nonzero(ends - starts > LONG_WORD)[0]:
        h[i] = int.from_bytes(hashlib.blake2b(_LOWER[data[starts[i] : ends[i]]].tobytes(), digest_size=8).digest(), "little")
    return np.searchsorted(offsets, starts, side="right") - 1, mix(h + (ends - starts).astype(np.uint64))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct shingles of every text, sorted."""
    texts, words = word_hashes(data, offsets)
    if not len(words):
        return texts, words
    factor = mix(np.arange(11, 11 + width, dtype=np.uint64))
    parts_t, parts_h = [], []
    if len(words) >= width:
        whole = texts[: len(texts) - width + 1] == texts[width - 1 :]
        h = sum(words[j : len(words) - width + 1 + j] * factor[j] for j in range(width))
        parts_t.append(texts[: len(texts) - width + 1][whole])
        parts_h.append(mix(h[whole]))
    starts, counts = runs(texts)
    for s, c in zip(starts[counts < width], counts[counts < width], strict=True):
        parts_t.append(texts[s : s + 1])
        parts_h.append(mix((words[s : s + c] * factor[:c]).sum(keepdims=True) + np.uint64(c)))
    t, h = np.concatenate(parts_t), np.concatenate(parts_h)
    order = np.lexsort((h, t))
    t, h = t[order], h[order]
    new = np.ones(len(t), bool)
    new[1:] = (t[1:] != t[:-1]) | (h[1:] != h[:-1])
    return t[new], h[new]


def slices(offsets: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about size bytes together; a longer text is a range of its own."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def class_ids(t: np.ndarray, h: np.ndarray, n: int, bits: int = 63) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Set size of each of n texts, an id of its set of so many bits (0: empty), and a second, independent digest of it."""
    counts = np.bincount(t, minlength=n)
    sums = np.zeros((2, n), np.uint64)
    some = np.nonzero(counts)[0]
    if len(t):
        first = np.concatenate([[0], np.cumsum(counts[some])[:-1]])
        for total, seed in zip(sums, (0xA0761D6478BD642F, 0xE7037ED1A0B428DB), strict=True):
            total[some] = np.add.reduceat(mix(h ^ np.uint64(seed)), first)
    ids, digest = mix(sums[0] + counts.astype(np.uint64)) >> np.uint64(64 - bits), mix(sums[1] ^ counts.astype(np.uint64))
    ids = np.where((counts > 0) & (ids == 0), 1, ids.astype(np.int64))
    return counts, np.where(counts > 0, ids, 0), digest.view(np.int64)


def apart(ids: np.ndarray, digests: np.ndarray, taken: np.ndarray) -> np.ndarray:
    """Ids anew, from id and digest, for those that several sets have taken (sorted)."""
    if not len(taken):
        return ids
    hit = taken[np.minimum(np.searchsorted(taken, ids), len(taken) - 1)] == ids
    new = (mix(ids.astype(np.uint64) ^ mix(digests.view(np.uint64))) >> np.uint64(1)).astype(np.int64)
    return np.where(hit, np.maximum(new, 1), ids)


def _sets(batches, width: int, text_at: int) -> Iterator[tuple]:
    """(batch, first row, last row, texts, shingles) by slices."""
    for batch in batches:
        data, offsets = utf8_column(batch.column(text_at))
        for a, b in slices(offsets, SLICE):
            yield batch, a, b, *shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width)


def classes(docs: DataFrame, width: int, text: str = "text", key: str = "doc_id", mark: str | None = None, bits: int = 63) -> DataFrame:
    """(doc_id, n_shingles, cls, digest) of every row, and its mark, a long that tells rows of one id apart."""
    import pyarrow as pa

    marks = [F.col(mark).cast("long").alias("mark")] if mark else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, a, b, t, h in _sets(batches, width, 1):
            counts, ids, digests = class_ids(t, h, b - a, bits)
            if b == batch.num_rows:
                give_back()
            own = [batch.column(2).slice(a, b - a)] if mark else []
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(counts.astype(np.int64)), pa.array(ids), pa.array(digests), *own], names=["doc_id", "n_shingles", "cls", "digest", "mark"][: 4 + len(own)])

    schema = "doc_id long, n_shingles long, cls long, digest long" + (", mark long" if marks else "")
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), *marks).mapInArrow(run, schema)


def told_apart(feats: DataFrame, taken: np.ndarray) -> DataFrame:
    """classes() with apart() ids."""
    import pyarrow as pa

    if not len(taken):
        return feats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, digests = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("cls", "digest"))
            at = batch.schema.get_field_index("cls")
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(apart(ids, digests, taken)), *batch.columns[at + 1 :]], schema=batch.schema)

    return feats.mapInArrow(run, feats.schema)


def postings(docs: DataFrame, width: int, buckets: int, text: str = "text", bits: int = 63, taken: np.ndarray = np.zeros(0, np.int64)) -> DataFrame:
    """Every class's tokens, in packed rows by token bucket: tokens, index into the row's classes, classes and set sizes."""
    import pyarrow as pa

    shift = np.uint64(64 - (buckets - 1).bit_length())
    names = ["bucket", "tokens", "which", "classes", "sizes"]

    def flush(t, h, ids, counts):
        _, first = np.unique(ids, return_index=True)
        keep = np.zeros(len(ids), bool)
        keep[first] = True
        keep &= ids != 0
        mine = keep[t]
        t, h = t[mine], h[mine]
        order = np.argsort(h)
        t, h = t[order], h[order]
        starts, lengths = runs(h >> shift)
        rows = []
        for s, c in zip(starts, lengths, strict=True):
            own, which = np.unique(t[s : s + c], return_inverse=True)
            steps = np.diff(h[s : s + c], prepend=np.uint64(0))
            rows.append((int(h[s] >> shift), pack(steps), pack(which.astype(np.uint32)), pack(ids[own].astype(np.uint64)), pack(counts[own].astype(np.uint32))))
        for at in range(0, len(rows), 64):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[at : at + 64], strict=True), [pa.int64()] + 4 * [pa.binary()], strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, texts = [], 0, 0

        def out():
            yield from flush(*(np.concatenate(x) for x in zip(*held, strict=True)))

        for _, a, b, t, h in _sets(batches, width, 0):
            counts, ids, digests = class_ids(t, h, b - a, bits)
            held.append((t + texts, h, apart(ids, digests, taken), counts))
            texts += b - a
            size += len(h)
            if size >= FLUSH:
                yield from out()
                held, size, texts = [], 0, 0
                give_back()
        if held:
            yield from out()
        give_back()

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "bucket long, tokens binary, which binary, classes binary, sizes binary")


def _rows(table, names) -> Iterator[tuple]:
    yield from zip(*(table.column(c).to_pylist() for c in names), strict=True)


def shared_tokens(posted: DataFrame, buckets: int) -> DataFrame:
    """Tokens that two classes or more hold, in packed rows by class bucket: classes, set sizes, tokens and their frequencies."""
    import pyarrow as pa

    bits = np.uint64(63 - (buckets - 1).bit_length())
    names = ["bucket", "classes", "sizes", "tokens", "frequencies"]
    kinds = [pa.int64()] + 4 * [pa.binary()]

    def run(table: pa.Table) -> pa.Table:
        h, c, n = [], [], []
        for tokens, which, own, sizes in _rows(table, ["tokens", "which", "classes", "sizes"]):
            at = unpack(which, np.uint32)
            h.append(np.cumsum(unpack(tokens, np.uint64), dtype=np.uint64))
            c.append(unpack(own, np.uint64)[at])
            n.append(unpack(sizes, np.uint32)[at])
        h, c, n = np.concatenate(h), np.concatenate(c), np.concatenate(n)
        order = np.lexsort((c, h))
        h, c, n = h[order], c[order], n[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
        h, c, n = h[new], c[new], n[new]
        _, lengths = runs(h)
        df = np.repeat(lengths, lengths)
        more = df > 1
        h, c, n, df = h[more], c[more], n[more], df[more].astype(np.uint32)
        order = np.argsort(c, kind="stable")
        h, c, n, df = h[order], c[order], n[order], df[order]
        starts, counts = runs(c >> bits)
        give_back()
        rows = [(int(c[s] >> bits), *(pack(x[s : s + k]) for x in (c, n, h, df))) for s, k in zip(starts, counts, strict=True)]
        return pa.table([pa.array(x, k) for x, k in zip(zip(*rows, strict=True) if rows else [[]] * 5, kinds, strict=True)], names=names)

    return posted.groupBy("bucket").applyInArrow(run, "bucket long, classes binary, sizes binary, tokens binary, frequencies binary")


def index_keys(tokens: np.ndarray, df: np.ndarray, n: int, percent: int, frequent: int) -> np.ndarray:
    """Index keys of one set of n tokens, of which these are shared with others, sorted by (frequency, token)."""
    need = -(-percent * n // 100)
    alone, keys = n - len(tokens), []
    if need <= GROUPS or percent * percent * n < 10_000 * (GROUPS + 2):  # it may link with a set too small for the longer prefix
        keys.append(tokens[: max(0, n - need + 1 - alone)])
    if need > GROUPS:
        head = slice(0, max(0, n - need + GROUPS + 1 - alone))
        t, often = tokens[head], df[head] > frequent
        keys.append(t[~often])
        t = t[often]
        group = mix(t ^ np.uint64(0xE7037ED1A0B428DB)) % np.uint64(GROUPS)
        for g in range(GROUPS):
            mine = t[group == g]
            if len(mine) > 1:
                i, j = np.triu_indices(len(mine), 1)
                keys.append(mix(mine[i] * np.uint64(0x8EBC6AF09C88C6E3) + mine[j]))
    return np.unique(np.concatenate(keys)) if keys else tokens[:0]


def indexed(shared: DataFrame, buckets: int, percent: int, frequent: int) -> DataFrame:
    """By class bucket: packed index rows (kind 0: key bucket; keys, classes and sizes) and a row for each class with keys (kind 1:
    its id; its size and shared tokens)."""
    import pyarrow as pa

    shift = np.uint64(64 - (buckets - 1).bit_length())
    names = ["kind", "id", "n", "keys", "classes", "sizes"]
    kinds = [pa.int32(), pa.int64(), pa.int64()] + 3 * [pa.binary()]

    def run(table: pa.Table) -> pa.Table:
        parts = [[unpack(x, k) for x, k in zip(row, (np.uint64, np.uint32, np.uint64, np.uint32), strict=True)] for row in _rows(table, ["classes", "sizes", "tokens", "frequencies"])]
        c, n, h, df = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((h, df, c))
        c, n, h, df = c[order], n[order], h[order], df[order]
        del parts
        give_back()
        out, keys, owners, sizes = [], [], [], []
        for s, k in zip(*runs(c), strict=True):
            mine = index_keys(h[s : s + k], df[s : s + k], int(n[s]), percent, frequent)
            if len(mine):
                keys.append(mine)
                owners.append(np.full(len(mine), c[s]))
                sizes.append(np.full(len(mine), n[s]))
                out.append((1, int(c[s]), int(n[s]), pack(np.sort(h[s : s + k])), None, None))
        if keys:
            keys, owners, sizes = np.concatenate(keys), np.concatenate(owners), np.concatenate(sizes)
            order = np.argsort(keys)
            keys, owners, sizes = keys[order], owners[order], sizes[order]
            for s, k in zip(*runs(keys >> shift), strict=True):
                out.append((0, int(keys[s] >> shift), None, *(pack(x[s : s + k]) for x in (keys, owners, sizes))))
        return pa.table([pa.array(x, k) for x, k in zip(zip(*out, strict=True) if out else [[]] * 6, kinds, strict=True)], names=names)

    return shared.groupBy("bucket").applyInArrow(run, "kind int, id long, n long, keys binary, classes binary, sizes binary")


def candidate_edges(index: DataFrame, percent: int) -> DataFrame:
    """(a, b): classes that share a key and may link by size, as a forest of edges from each key bucket."""
    import pyarrow as pa

    def run(table: pa.Table) -> pa.Table:
        parts = [[unpack(x, k) for x, k in zip(row, (np.uint64, np.uint64, np.uint32), strict=True)] for row in _rows(table, ["keys", "classes", "sizes"])]
        k, c, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((c, n, k))
        k, c, n = k[order], c[order], n[order].astype(np.int64)
        # neighbours by size: a gap in sizes that no link bridges ends a chain
        joined = (k[1:] == k[:-1]) & (c[1:] != c[:-1]) & (100 * n[:-1] >= percent * n[1:])
        a, b = c[1:][joined].astype(np.int64), c[:-1][joined].astype(np.int64)
        pairs = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], 1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
        parent: dict[int, int] = {}

        def root(x):
            while (p := parent.get(x, x)) != x:
                parent[x] = x = parent.get(p, p)
            return x

        for x, y in pairs.tolist():
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
        kids = list(parent)
        return pa.table([pa.array(kids, pa.int64()), pa.array([root(x) for x in kids], pa.int64())], names=["a", "b"])

    return index.where("kind = 0").groupBy("id").applyInArrow(run, "a long, b long").where("a <> b")


def linked_parts(sizes: np.ndarray, sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For each set the first set that it is linked with through others. Walks through the links; overlaps are counted only with sets
    not reached yet."""
    m = len(sets)
    member = np.repeat(np.arange(m), [len(s) for s in sets])
    tokens = np.concatenate(sets) if m else np.zeros(0, np.uint64)
    _, tokens = np.unique(tokens, return_inverse=True)
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    part, left = np.full(m, -1), np.ones(m, bool)

    def postings_of(alive):
        keep = alive[member]
        t, who = tokens[keep], member[keep]
        order = np.argsort(t, kind="stable")
        starts = np.searchsorted(t[order], np.arange(tokens.max(initial=-1) + 2))
        return starts, who[order], int(alive.sum())

    starts, who, built = postings_of(left)
    for seed in range(m):
        if part[seed] >= 0:
            continue
        part[seed], left[seed], queue = seed, False, [seed]
        while queue:
            x = queue.pop()
            alive = int(left.sum())
            if not alive:
                break
            if alive < built // 2:
                starts, who, built = postings_of(left)
            mine = tokens[bounds[x] : bounds[x + 1]]
            lengths = starts[mine + 1] - starts[mine]
            some = lengths > 0
            a, lengths = starts[mine][some], lengths[some]
            if not len(a):
                continue
            at = np.repeat(a - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
            shared = np.bincount(who[at], minlength=m)
            near = np.nonzero(left & (shared > 0) & (100 * shared >= percent * (sizes + sizes[x] - shared)))[0]
            part[near], left[near] = seed, False
            queue += near.tolist()
    return part


def verified(sets: DataFrame, roots: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """(a, b): links as a forest. sets: kind 1 rows of indexed(); roots: components of candidates."""
    import pyarrow as pa

    both = roots.select(F.col("node").alias("id"), "root").unionByName(roots.select(F.col("root").alias("id"), "root").distinct())
    sizes = materialize(roots.groupBy("root").agg((F.count("*") + 1).alias("_n")).select("root", "_n"), "candidate-sizes")
    large = sizes.where(F.col("_n") > block).select(F.col("root").alias("_large"), F.ceil(F.col("_n") / block).cast("int").alias("_nb"))
    placed = sets.where("kind = 1").select("id", "n", "keys").join(both, "id")
    if large.limit(1).count():  # few: each holds over a block of classes
        placed = placed.join(large, F.col("root") == F.col("_large"), "left")
        own = F.pmod(F.xxhash64("id"), F.coalesce("_nb", F.lit(1)))
        pair = F.transform(F.sequence(F.lit(0), F.coalesce("_nb", F.lit(1)) - 1), lambda j: F.struct(F.least(own, j.cast("long")).alias("i"), F.greatest(own, j.cast("long")).alias("j")))
        placed = placed.select("id", "n", "keys", "root", F.explode(pair).alias("p")).select("id", "n", "keys", "root", "p.i", "p.j")
    else:
        placed = placed.select("id", "n", "keys", "root", F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def groups():
            held, at = [], None
            for batch in batches:
                for cls, n, keys, *where in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if where != at and held:
                        yield held
                        held = []
                    at = where
                    held.append((cls, n, unpack(keys, np.uint64)))
            if held:
                yield held

        for group in groups():
            if len(group) < 2:
                continue
            group.sort(key=lambda g: g[0])
            ids = np.array([g[0] for g in group])
            part = linked_parts(np.array([g[1] for g in group]), [g[2] for g in group], percent)
            linked = np.nonzero(part != np.arange(len(part)))[0]
            yield pa.RecordBatch.from_arrays([pa.array(ids[linked]), pa.array(ids[part[linked]])], names=["a", "b"])

    return placed.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j").mapInArrow(run, "a long, b long")


def _linked(docs: DataFrame, width: int, percent: int, text: str, key: str, mark: str | None, bits: int = 63) -> tuple[DataFrame, DataFrame, int]:
    """Rows of classes(), (cls, root, least, _n) of every class of a nonempty set, and the number of rows. least is the class's smallest
    doc_id or, with a mark, its smallest (no id, doc_id, mark). Ids that sets of different digest or size have taken are made anew: of
    63 bits that happens about once in 4e9 different sets."""
    feats = materialize(classes(docs, width, text, key, mark, bits), "classes")
    total = feats.count()
    buckets = 1 << max(6, (total // 4000).bit_length())
    least = F.min(row_key() if mark else F.col("doc_id")).alias("least")
    sets = lambda df: materialize(df.where("cls <> 0").groupBy("cls").agg(least, F.count("*").alias("_n"), ((F.min("digest") != F.max("digest")) | (F.min("n_shingles") != F.max("n_shingles"))).alias("several")), "sets")
    members = sets(feats)
    taken = np.sort(np.array([r.cls for r in members.where("several").select("cls").collect()], np.int64))
    if len(taken):
        feats = told_apart(feats, taken)
        members = sets(feats)
    posted = postings(docs, width, buckets, text, bits, taken)
    index = materialize(indexed(shared_tokens(posted, buckets), buckets, percent, frequent=max(64, total // 1000)), "prefix-index")
    roots = components(materialize(candidate_edges(index, percent), "candidates"))
    links = components(materialize(verified(index, roots, percent), "links"))
    rooted = members.join(links, F.col("cls") == F.col("node"), "left").select("cls", "least", "_n", F.coalesce("root", "cls").alias("root"))
    return feats, materialize(rooted, "members"), total


def row_key(key: str = "doc_id", mark: str = "mark") -> Column:
    """What tells rows apart and orders them, without nulls inside: rows that have no id come last."""
    return F.struct(F.col(key).isNull().alias("no_id"), F.coalesce(F.col(key).cast("long"), F.lit(0).cast("long")).alias("doc_id"), F.col(mark).alias("mark"))


def join_components(docs: DataFrame, width: int = 5, percent: int = 75, text: str = "text", key: str = "doc_id", bits: int = 63) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: component_id is the smallest doc_id that links reach."""
    feats, rooted, total = _linked(docs, width, percent, text, key, None, bits)
    sums = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("_n"))
    named = materialize(lookup(rooted.withColumnRenamed("_n", "_rows"), sums.withColumnRenamed("root", "r"), "root", "r", total), "components")
    named = named.where("_rows > 1 OR component_id <> least").select(F.col("cls").alias("c"), "component_id", F.col("_rows").alias("_n"))
    out = lookup(feats, named, "cls", "c", total)
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def linked_rows(docs: DataFrame, mark: str, width: int = 5, percent: int = 75, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(row, first, _n) of the distinct rows that have a link or an equal set beside them: row is their row_key(), first tells the
    smallest of each component, and _n counts its repetitions. Rows that only share an id, or have none, are not linked by that; an equal
    mark and id must mean an equal text."""
    feats, rooted, total = _linked(docs, width, percent, text, key, mark)
    sums = rooted.groupBy("root").agg(F.min("least").alias("first"), F.count("*").alias("_classes"), F.count("*").alias("_n"))
    named = materialize(lookup(rooted.withColumnRenamed("_n", "_rows"), sums.withColumnRenamed("root", "r"), "root", "r", total), "components")
    named = named.where("_rows > 1 OR _classes > 1").select(F.col("cls").alias("c"), F.col("first"), F.col("_rows").alias("_n"))
    rows = lookup(feats, named, "cls", "c", total).where("first IS NOT NULL").select(row_key().alias("row"), "first")
    return rows.select("row", (F.col("row") == F.col("first")).alias("first")).groupBy("row").agg(F.max("first").alias("first"), F.count("*").alias("_n"))
