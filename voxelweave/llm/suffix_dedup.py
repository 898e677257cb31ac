"""Removal of long strings that repeat across or within texts, by a logarithmic family of suffix arrays.

A byte goes if a string of `length` bytes that covers it also starts earlier: in a text of a smaller id, or earlier in the same text.

Suffixes are sampled by content. Of the ANCHOR-byte strings in a window of `length` bytes the one with the smallest hash is the window's
anchor, so equal windows have equal anchors at equal offsets; a run of windows with one anchor is a stretch. Three steps follow.

1. Anchor hashes are counted by bucket; a stretch whose anchor occurs once cannot repeat. Anchors that a packed batch holds several times
   are summed there, so a common one is a record for each batch.
2. Stretches of the other anchors are cut from the texts and dealt by anchor. Stretches that a batch holds several times are sent once.
   Hot anchors are dealt by the content of each window instead, so no bucket gets a common one whole.
3. A bucket keeps the logarithmic family. Batches in the order of the texts get sorted arrays of suffixes, are merge-scanned against the
   levels for suffixes that match an earlier one in all bytes, and become a level; levels of equal size merge. Whole stretches come
   first; those that differ but share an anchor then go through a second family, window by window.

Nothing is removed on a hash alone: batches and families compare bytes.

Cases: a null text is empty; texts below the length lose nothing; below ANCHOR bytes of length each window is its own anchor; rows that
repeat an id and text get the same result each and do not remove each other; different texts under one id count as one document with
the earlier start first; a null id counts as smaller than any other; extra columns are dropped or carried; a text of any length is
looked at in pieces of SLICE bytes; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelweave.llm.common import bundle, give_back, materialize, mix, runs, unbundle, utf8_column
from voxelweave.llm.jaccard_join import _BYTES, _powers, slices

#: Bytes of an anchor; bytes of text looked at, anchors counted, and bytes of text cut at once; strings of a batch, and of a family.
ANCHOR, SLICE, FLUSH, CUT, BATCH, FAMILY = 40, 1 << 19, 400_000, 4 << 20, 1 << 16, 1 << 19
#: Bytes of text for each bucket of anchors, and of stretches. An anchor is hot that occurs once in HOT bytes of text and HOT_LEAST times.
ANCHOR_BUCKET, STRETCH_BUCKET, HOT, HOT_LEAST = 16 << 20, 4 << 20, 620_000, 256
NO_ID = -(1 << 63)
ALONE = 0xFFFFFFFF

DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
TEXT = "doc_id long, spans array<struct<start:int,end:int>>, kept binary, kept_text string"
_DEALT = "bucket long, data binary"


def stretches(data: np.ndarray, offsets: np.ndarray, length: int, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """(text, anchor hash, anchor place, bytes before it, windows beside the first) of each stretch; places count from the text's start."""
    n, anchor = len(data), min(anchor, length)
    none = tuple(np.zeros(0, k) for k in (np.int64, np.uint64, np.int64, np.int64, np.int64))
    sizes = np.diff(offsets)
    if n < length or not (sizes >= length).any():
        return none
    up, down = _powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[data] * up[:n], out=total[1:])
    h = mix((total[anchor:] - total[:-anchor]) * down[: n - anchor + 1])
    del total
    # the leftmost smallest hash of the anchors in each window, by windows of 1, 2, 4 ... anchors
    wide = length - anchor + 1
    at, span = np.arange(len(h), dtype=np.int32), 1
    low = h
    while span < wide:
        step = min(span, wide - span)
        a, b = low[: len(low) - step], low[step:]
        right = b < a
        at = np.where(right, at[step:], at[: len(at) - step])
        low = np.where(right, b, a)
        span += step
    windows = np.arange(n - length + 1)
    text = np.searchsorted(offsets, windows, side="right") - 1
    inside = windows + length <= offsets[text + 1]
    windows, at, text = windows[inside], at[: n - length + 1][inside], text[inside]
    if not len(windows):
        return none
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
    first = np.nonzero(new)[0]
    last = np.concatenate([first[1:], [len(at)]]) - 1
    p, s, text = at[first].astype(np.int64), windows[first], text[first]
    return text, h[p], p - offsets[text], p - s, windows[last] - s


def pieces(data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[int, int, tuple]]:
    """(first text, last text, stretches) of about SLICE bytes at a time; a longer text comes in pieces that share length - 1 bytes, so
    each window lies in one of them."""
    for a, b in slices(offsets, SLICE):
        start, end = int(offsets[a]), int(offsets[b])
        if b - a > 1 or end - start <= SLICE + length:
            yield a, b, stretches(data[start:end], offsets[a : b + 1] - start, length)
            continue
        for at in range(start, end - length + 1, SLICE):
            part = data[at : min(end, at + SLICE + length - 1)]
            text, h, p, before, more = stretches(part, np.array([0, len(part)]), length)
            yield a, b, (text, h, p + (at - start), before, more)


def _rows(batch: list[tuple[int, bytes]]):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in batch], pa.int64()), pa.array([r[1] for r in batch], pa.binary())], names=["bucket", "data"])


def _by_text(ids: np.ndarray, fps: np.ndarray, texts: int, *columns: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Packed rows by text bucket. Their buckets are negative, so they pass through a grouping by anchor untouched."""
    to = mix(ids.astype(np.uint64) ^ fps.astype(np.uint64)) % np.uint64(texts)
    order = np.lexsort((columns[0], fps, ids, to))
    for s, k in zip(*runs(to[order]), strict=True):
        x = order[s : s + k]
        yield -1 - int(to[x[0]]), bundle([ids[x], fps[x], *(c[x].astype(np.uint32) for c in columns)])


def sampled(docs: DataFrame, length: int, buckets: int, texts: int) -> DataFrame:
    """Anchors of all texts in packed rows by anchor bucket, and by text bucket the stretches of anchors that a batch holds several
    times. docs: (doc_id, fp, text), fp a hash that tells texts of one id apart."""
    import pyarrow as pa

    shift = np.uint64(64 - (buckets - 1).bit_length())

    def flush(held):
        text, h, p, before, more = (np.concatenate([x[i] for x in held]) for i in range(5))
        ids, fps = (np.concatenate([x[i] for x in held]) for i in (5, 6))
        held.clear()
        order = np.argsort(h)
        text, h, p, before, more = (x[order] for x in (text, h, p, before, more))
        s, k = runs(h)
        alone = np.repeat(k == 1, k)
        rows = list(_by_text(ids[text[~alone]], fps[text[~alone]], texts, p[~alone], before[~alone], more[~alone]))
        many, counts = h[s[k > 1]], k[k > 1]
        text, h, p, before, more = (x[alone] for x in (text, h, p, before, more))
        own, others = h >> shift, many >> shift
        for b in np.union1d(own, others):
            x = slice(*np.searchsorted(own, [b, b + np.uint64(1)]))
            y = slice(*np.searchsorted(others, [b, b + np.uint64(1)]))
            mine, which = np.unique(text[x], return_inverse=True)
            steps = (np.diff(v[z] >> np.uint64(12), prepend=np.uint64(0)) for v, z in ((h, x), (many, y)))
            rows.append((int(b), bundle([*steps, counts[y].astype(np.uint32), p[x].astype(np.uint32), before[x].astype(np.uint32), more[x].astype(np.uint32), which.astype(np.uint32), ids[mine], fps[mine]])))
        for at in range(0, len(rows), 64):
            yield _rows(rows[at : at + 64])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, count = [], 0, 0
        for batch in batches:
            data, offsets = utf8_column(batch.column(2))
            ids, fps = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            for a, b, found in pieces(data, offsets, length):
                held.append((found[0] + count, *found[1:], ids[a:b], fps[a:b]))
                count += b - a
                size += len(found[0])
                if size >= FLUSH:
                    yield from flush(held)
                    size, count = 0, 0
                    give_back()
        if size:
            yield from flush(held)
        give_back()

    return docs.select("doc_id", "fp", "text").mapInArrow(run, _DEALT)


_ANCHORS = (np.uint64, np.uint64, np.uint32, np.uint32, np.uint32, np.uint32, np.uint32, np.int64, np.int64)


def shared(found: DataFrame, texts: int, hot: int) -> DataFrame:
    """Stretches whose anchor occurs more than once, by text bucket, and the hashes of anchors that occur over hot times."""
    import pyarrow as pa

    def run(key: tuple, table: pa.Table) -> pa.Table:
        data = table.column("data")
        if key[0].as_py() < 0:
            return pa.table([table.column("bucket"), data, pa.nulls(len(table), pa.int64())], names=["bucket", "data", "hot"])
        parts, common, counts = [], [], []
        for x in data:
            steps, many, k, p, before, more, which, ids, fps = unbundle(x.as_py(), _ANCHORS)
            parts.append((np.cumsum(steps, dtype=np.uint64), p, before, more, ids[which], fps[which]))
            common.append(np.cumsum(many, dtype=np.uint64))
            counts.append(k)
        h, p, before, more, ids, fps = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        names, place = np.unique(np.concatenate([h, *common]), return_inverse=True)
        total = np.bincount(place[len(h) :], weights=np.concatenate(counts), minlength=len(names)).astype(np.int64)
        total += np.bincount(place[: len(h)], minlength=len(names))
        take = total[place[: len(h)]] > 1
        rows = list(_by_text(ids[take], fps[take], texts, p[take], before[take], more[take]))
        common = names[total > hot].astype(np.int64).tolist()
        give_back()
        return pa.table([pa.array([r[0] for r in rows] + [None] * len(common), pa.int64()), pa.array([r[1] for r in rows] + [None] * len(common), pa.binary()), pa.array([None] * len(rows) + common, pa.int64())], names=["bucket", "data", "hot"])

    return found.groupBy("bucket").applyInArrow(run, f"{_DEALT}, hot long")


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of spans that overlap or touch."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > reach[:-1]
    first = np.nonzero(new)[0]
    return starts[first], reach[np.concatenate([first[1:], [len(starts)]]) - 1]


def by_text(dealt: DataFrame, columns: int, join: bool) -> DataFrame:
    """(id, fp, marks) of each text: the columns of its packed rows as 32-bit arrays one after the other; with join, spans are merged."""
    import pyarrow as pa

    def run(table: pa.Table) -> pa.Table:
        parts = [unbundle(x.as_py(), (np.int64, np.int64, *[np.uint32] * columns)) for x in table.column("data")]
        ids, fps, *values = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        order = np.lexsort((*values[::-1], fps, ids))
        ids, fps, *values = (x[order] for x in (ids, fps, *values))
        new = np.ones(len(ids), bool)  # rows that repeat an id and text have the same marks
        new[1:] = np.any([x[1:] != x[:-1] for x in (ids, fps, *values)], axis=0)
        ids, fps, *values = (x[new] for x in (ids, fps, *values))
        new = np.ones(len(ids), bool)
        new[1:] = (ids[1:] != ids[:-1]) | (fps[1:] != fps[:-1])
        first = np.nonzero(new)[0]
        marks = []
        for s, e in zip(first, [*first[1:], len(ids)], strict=True):
            own = merged(*(v[s:e] for v in values)) if join else [v[s:e] for v in values]
            marks.append(np.concatenate(own).tobytes())
        give_back()
        return pa.table([pa.array(ids[first]), pa.array(fps[first]), pa.array(marks, pa.binary())], names=["id", "fp", "marks"])

    return dealt.groupBy("bucket").applyInArrow(run, "id long, fp long, marks binary")


def keyed(data: np.ndarray, starts: np.ndarray, lens: np.ndarray, width: int) -> np.ndarray:
    """data[start:start + len] of each as fixed-width strings that are equal only where these are; data has width bytes to spare."""
    m = np.zeros((len(starts), width + 4), np.uint8)
    m[:, :4] = lens.astype(">u4").view(np.uint8).reshape(-1, 4)
    if len(starts):
        m[:, 4:] = np.lib.stride_tricks.sliding_window_view(data, width)[starts]
        m[:, 4:][np.arange(width)[None, :] >= lens[:, None]] = 0
    return m.view(f"S{width + 4}").ravel()


class SuffixLevels:
    """Levels of sorted suffixes, each cut to its first `length` bytes, with the labels they came with; level i came of 2**i batches."""

    def __init__(self, length: int):
        self.length = length
        self.levels: list[tuple[np.ndarray, np.ndarray] | None] = []

    def scan(self, suffixes: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """Sorts a batch of suffixes, in the order of their texts, merge-scans it against the levels, and keeps those that are new. For
        each the label of an earlier one that is equal over the length, or -1."""
        order = np.argsort(suffixes, kind="stable")
        s = suffixes[order]
        new = np.ones(len(s), bool)
        new[1:] = s[1:] != s[:-1]
        lead = np.nonzero(new)[0]  # the first of each run of equal ones meets the levels
        found = np.full(len(lead), -1, np.int64)
        for level in self.levels:
            if level is not None:
                at = np.minimum(np.searchsorted(level[0], s[lead]), len(level[0]) - 1)
                found = np.where(level[0][at] == s[lead], level[1][at], found)
        earlier = np.where(found >= 0, found, labels[order[lead]])[np.cumsum(new) - 1]
        earlier[lead] = found
        keep, i = (s[lead[found < 0]], labels[order[lead[found < 0]]]), 0
        while len(keep[0]):
            if i == len(self.levels):
                self.levels.append(None)
            if self.levels[i] is None:
                self.levels[i] = keep
                break
            both = [np.concatenate(x) for x in zip(self.levels[i], keep, strict=True)]
            by = np.argsort(both[0], kind="stable")
            keep = both[0][by], both[1][by]
            self.levels[i] = None
            i += 1
        out = np.empty(len(s), np.int64)
        out[order] = earlier
        return out

    def add(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """scan() of the suffixes of data from starts; tells which match an earlier one."""
        suffixes = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, self.length)[starts]).view(f"S{self.length}").ravel()
        return self.scan(suffixes, np.arange(len(starts))) >= 0


def _hash(data: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """The hash of data[at:at + width], as stretches() gives it."""
    up, _ = _powers(width + 1)
    total = np.zeros(len(at), np.uint64)
    for j in range(width):
        total += _BYTES[data[at + j]] * up[j]
    return mix(total)


def cut(joined: DataFrame, length: int, buckets: int, texts: int, common: np.ndarray) -> DataFrame:
    """The bytes of marked stretches in packed rows by bucket, one for those that a batch holds several times; the others are spans to
    remove, by text bucket. joined: (doc_id, fp, text, marks); common: sorted hashes of hot anchors."""
    import pyarrow as pa

    anchor, wide = min(ANCHOR, length), length + max(0, length - ANCHOR)
    shipped = joined.sparkSession.sparkContext.broadcast(common)  # bounded by HOT

    def flush(held):
        common = shipped.value
        raw = b"\0".join(h[2] for h in held) + bytes(wide + 1)  # a byte between texts keeps their spans apart
        data = np.frombuffer(raw, np.uint8)
        sizes = np.array([len(h[2]) + 1 for h in held])
        base = np.cumsum(sizes) - sizes
        ids, fps = (np.array([h[i] for h in held], np.int64) for i in (0, 1))
        marks = [np.frombuffer(h[3], np.uint32).reshape(3, -1).astype(np.int64) for h in held]
        row = np.repeat(np.arange(len(held)), [m.shape[1] for m in marks])
        p, before, more = np.concatenate(marks, 1)
        p += base[row]
        start, size, to = p - before, more + length, _hash(data, p, anchor)
        hot = common[np.minimum(np.searchsorted(common, to >> np.uint64(12)), len(common) - 1)] == to >> np.uint64(12) if len(common) else np.zeros(len(to), bool)
        batches = [(row[x], start[x], before[x], size[x], to[x]) for x in np.array_split(np.nonzero(~hot)[0], max(1, -(-int((~hot).sum()) // BATCH)))]
        at = np.nonzero(hot)[0]
        for x in np.array_split(at, max(1, -(-int((more[at] + 1).sum()) // BATCH))) if len(at) else []:
            k = more[x] + 1
            each = np.repeat(start[x], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            batches.append((np.repeat(row[x], k), each, np.full(len(each), ALONE), np.full(len(each), length), _hash(data, each, length)))
        gone_a, gone_b = [], []
        for row, start, before, size, to in batches:
            order = np.lexsort((fps[row], start - base[row], ids[row]))
            row, start, before, size, to = (x[order] for x in (row, start, before, size, to))
            first = SuffixLevels(wide + 4).scan(keyed(data, start, size, wide), np.arange(len(start)))
            again = (first >= 0) & ((ids[row] != ids[row[first]]) | (start - base[row] != start[first] - base[row[first]]))
            gone_a.append(start[again])
            gone_b.append(start[again] + size[again])
            x = np.nonzero(~again)[0]
            bucket = mix(to[x]) % np.uint64(buckets)
            x, bucket = x[np.argsort(bucket, kind="stable")], np.sort(bucket)
            rows = []
            for s, k in zip(*runs(bucket), strict=True):
                y = x[s : s + k]
                own = b"".join([raw[a : a + n] for a, n in zip(start[y].tolist(), size[y].tolist(), strict=True)])
                rows.append((int(bucket[s]), bundle([ids[row[y]], fps[row[y]], (start[y] - base[row[y]]).astype(np.uint32), before[y].astype(np.uint32), size[y].astype(np.uint32), np.frombuffer(own, np.uint8)])))
            for at in range(0, len(rows), 64):
                yield _rows(rows[at : at + 64])
        a, b = merged(np.concatenate(gone_a), np.concatenate(gone_b))
        row = np.searchsorted(base, a, side="right") - 1
        rows = list(_by_text(ids[row], fps[row], texts, a - base[row], b - base[row]))
        for at in range(0, len(rows), 64):
            yield _rows(rows[at : at + 64])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for doc_id, fp, text, marks in zip(*batch.columns, strict=True):
                held.append((doc_id.as_py(), fp.as_py(), text.as_py().encode(), marks.as_py()))
                size += len(held[-1][2])
                if size >= CUT:
                    yield from flush(held)
                    held, size = [], 0
                    give_back()
        if held:
            yield from flush(held)
        give_back()

    return joined.select("doc_id", "fp", "text", "marks").mapInArrow(run, _DEALT)


_STRETCHES = (np.int64, np.int64, np.uint32, np.uint32, np.uint32, np.uint8)


def matched(parts: DataFrame, length: int, texts: int) -> DataFrame:
    """Spans to remove, by text bucket: a logarithmic family over the stretches of a bucket, and one over the windows of those that share
    an anchor but differ."""
    import pyarrow as pa

    anchor, wide = min(ANCHOR, length), length + max(0, length - ANCHOR)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        if key[0].as_py() < 0:
            return table.select(["bucket", "data"])
        ids, fps, start, before, size, data = (np.concatenate(x) for x in zip(*(unbundle(x.as_py(), _STRETCHES) for x in table.column("data")), strict=True))
        start, size = start.astype(np.int64), size.astype(np.int64)
        place = np.cumsum(size) - size
        data = np.concatenate([data, np.zeros(wide, np.uint8)])
        order = np.lexsort((fps, start, ids))
        new = np.ones(len(order), bool)  # rows that repeat an id and text hold the same stretches
        new[1:] = np.any([x[order[1:]] != x[order[:-1]] for x in (ids, fps, start, size)], axis=0)
        order = order[new]
        family, differ, out = SuffixLevels(wide + 4), [], []
        # two texts under one id with one start: neither is earlier, so neither removes the other
        later = lambda x, y: (y >= 0) & ((ids[x] != ids[y]) | (start[x] != start[y]))
        for at in range(0, len(order), BATCH):
            x = order[at : at + BATCH]
            again = later(x, family.scan(keyed(data, place[x], size[x], wide), x))
            out.append((ids[x[again]], fps[x[again]], start[x[again]], (start + size)[x[again]]))
            differ.append(x[~again])
        x = np.concatenate(differ)
        x = x[before[x] != ALONE]
        del family
        if len(x):
            names = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, anchor)[place[x] + before[x]]).view(f"S{anchor}").ravel()
            _, name, counts = np.unique(names, return_inverse=True, return_counts=True)
            x, name = x[counts[name] > 1], name[counts[name] > 1]
            by = np.argsort(name, kind="stable")
            x, name = x[by], name[by]
        held, seen, family = 0, -1, SuffixLevels(length)
        at = 0
        ends = np.cumsum(size[x] - length + 1)
        while at < len(x):
            if held >= FAMILY and name[at] != seen:  # windows of different anchors differ: a new family can begin
                held, family = 0, SuffixLevels(length)
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BATCH, side="right")))
            mine, k = x[at:to], size[x[at:to]] - length + 1
            owner = np.repeat(np.arange(len(mine)), k)
            offset = np.arange(len(owner)) - np.repeat(np.cumsum(k) - k, k)
            windows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, length)[place[mine][owner] + offset]).view(f"S{length}").ravel()
            code = (mine[owner] << 32) + offset
            first = family.scan(windows, code)
            other = np.maximum(first, 0)
            gone = np.nonzero((first >= 0) & ((ids[mine][owner] != ids[other >> 32]) | (start[mine][owner] + offset != start[other >> 32] + (other & ALONE))))[0]
            if len(gone):
                begin = np.concatenate([[0], np.nonzero((owner[gone][1:] != owner[gone][:-1]) | (offset[gone][1:] != offset[gone][:-1] + 1))[0] + 1])
                end = np.concatenate([begin[1:], [len(gone)]]) - 1
                who = mine[owner[gone[begin]]]
                out.append((ids[who], fps[who], start[who] + offset[gone[begin]], start[who] + offset[gone[end]] + length))
            held, seen, at = held + len(windows), name[to - 1], to
        rows = list(_by_text(*(np.concatenate([o[i] for o in out]) for i in (0, 1)), texts, *(np.concatenate([o[i] for o in out]) for i in (2, 3)))) if out else []
        give_back()
        return pa.table([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "data"])

    return parts.groupBy("bucket").applyInArrow(run, _DEALT)


def _finish(text: bytes, marks: bytes | None, whole: bool, keep_bytes: bool) -> tuple:
    """The result's values after doc_id."""
    starts, ends = np.frombuffer(marks or b"", np.uint32).reshape(2, -1).tolist()
    at, kept = 0, []
    for a, b in zip(starts, ends, strict=True):
        kept.append(text[at:a])
        at = b
    kept = b"".join([*kept, text[at:]])
    if whole:
        return [{"start": a, "end": b} for a, b in zip(starts, ends, strict=True)], kept if keep_bytes else None, kept.decode("utf-8", "ignore")
    return len(text), len(text) - len(kept), len(starts), hashlib.sha256(kept).hexdigest()


def remove_repeats(docs: DataFrame, length: int = 100, text: str = "text", key: str = "doc_id", whole: bool = False, carry: tuple[str, ...] | list[str] = (), keep_bytes: bool = True) -> DataFrame:
    """A row for every text: spans removed, bytes kept and the whole characters among them (whole; without keep_bytes the bytes are
    null), or their digests; and the columns to carry along."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    if length < 1:
        raise ValueError("length must be 1 or more")
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    power = lambda size: 1 << max(8, (total // size).bit_length())
    anchors, texts, buckets = power(ANCHOR_BUCKET), power(ANCHOR_BUCKET), power(STRETCH_BUCKET)
    taken = F.struct(*[F.col(c) for c in carry]) if carry else F.lit(None).cast("boolean")
    named = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("fp"), F.coalesce(F.col(text), F.lit("")).alias("text"), taken.alias("carry"))

    def marked(marks: DataFrame, how: str) -> DataFrame:
        right = marks.withColumnsRenamed({"id": "_id", "fp": "_fp"}).hint("shuffle_hash")
        return named.join(right, (F.col("doc_id") == F.col("_id")) & (F.col("fp") == F.col("_fp")), how).select(*named.columns, "marks")

    found = materialize(shared(sampled(named, length, anchors, texts), texts, max(HOT_LEAST, total // HOT)), "shared-anchors")
    common = np.sort(np.array([r[0] for r in found.where("hot IS NOT NULL").select("hot").distinct().collect()], np.int64).view(np.uint64))
    looks = by_text(found.where("bucket IS NOT NULL").select("bucket", "data"), 3, False)
    parts = cut(marked(looks, "inner"), length, buckets, texts, common)
    out = marked(by_text(matched(parts, length, texts), 2, True), "left")

    schema, kinds = (TEXT, [pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.binary(), pa.string()]) if whole else (DIGEST, [pa.int64()] * 4 + [pa.string()])
    names = [x.split(" ")[0] for x in schema.split(", ")]
    carried = named.schema["carry"].dataType
    kinds.append(to_arrow_type(carried))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [(d, *_finish(t.encode(), m, whole, keep_bytes), c) for d, t, m, c in zip(*(x.to_pylist() for x in part.columns), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[*names, "carry"])
            give_back()

    out = out.select("doc_id", "text", "marks", "carry").mapInArrow(finish, f"{schema}, carry {carried.simpleString()}")
    return out.select(F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), *names[1:], *[F.col(f"carry.{c}").alias(c) for c in carry])
