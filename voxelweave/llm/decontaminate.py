"""Benchmark decontamination: one Aho-Corasick automaton over normalised test items, scanned once over each text.

Normalised text is lower-case words joined by single spaces; each window of an item (13 words, or all of a shorter item) is a pattern
with a space at either end, so a match is always of whole words. Matches are joined as they come to maximal runs of hit words, which map
back to byte ranges of the original text, and to the set of items that they are of.

Cases: a null or wordless text has no words and no hits; a null or wordless item has no window; items with one id count once, a null
id is written "null"; repeated rows are scanned each; an empty table of items marks nothing; an empty table of texts gives an empty
table; other columns stay, names clashing with the results excepted.

The automaton is broadcast. Its patterns are split into blocks of at most BLOCK characters, each with its own pass over the texts, so
what is broadcast stays bounded however large the benchmark is.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of patterns in one automaton.
BLOCK = 16 << 20

#: Bytes that are no part of a word: fixed values of the rule.
_SPACE = [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
_TABLE = bytes(0x20 if b in _SPACE else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_WORD = re.compile(rb"[^ ]+")
_STATE: dict = {}

HITS = T.ArrayType(T.StructType([T.StructField(c, T.IntegerType()) for c in ("first_word", "words", "start_byte", "end_byte")]))
ITEMS = T.ArrayType(T.StringType())


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


def windows(text: str | None, width: int) -> set[bytes]:
    words = words_of(text)
    if not words:
        return set()
    return {b" " + b" ".join(words[i : i + width]) + b" " for i in range(max(1, len(words) - width + 1))}


def pattern_blocks(items: DataFrame, width: int, block: int = BLOCK) -> Iterator[dict[str, tuple[str, ...]]]:
    """Window -> ids of the items that have it, a bounded block at a time; the rows are streamed to the driver, never held whole."""
    held: dict[str, set] = defaultdict(set)
    size = 0
    for item_id, text in items.toLocalIterator():
        for w in windows(text, width):
            w = w.decode("latin-1")
            size += len(w)
            held[w].add("null" if item_id is None else str(item_id))
        if size >= block:
            yield {w: tuple(sorted(ids)) for w, ids in held.items()}
            held, size = defaultdict(set), 0
    if held:
        yield {w: tuple(sorted(ids)) for w, ids in held.items()}


def _automaton(shipped):
    import ahocorasick

    key, patterns = shipped.value
    if _STATE.get("key") != key:
        automaton = ahocorasick.Automaton()
        for w, ids in patterns.items():
            automaton.add_word(w, (w.count(" ") - 1, len(w), ids))
        automaton.make_automaton()
        _STATE.update(key=key, automaton=automaton)
    return _STATE["automaton"]


def joined(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of [first, end) spans that overlap or touch; spans come by their ends, and only the runs are held."""
    out: list[tuple[int, int]] = []
    for first, end in spans:
        while out and out[-1][1] >= first:
            before = out.pop()
            first, end = min(first, before[0]), max(end, before[1])
        out.append((first, end))
    return out


def scan(text: str | None, automaton) -> tuple[int, list[tuple], set[str]]:
    """Words of the text; (first word, words, start byte, end byte) of each run of hit words; and the items with a match."""
    data = (text or "").encode().translate(_TABLE)
    words = data.split()
    if not words or automaton is None:
        return len(words), [], set()
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    starts, items = np.cumsum(sizes) - sizes, set()

    def matches():
        for end, (n, length, ids) in automaton.iter((b" " + b" ".join(words) + b" ").decode("latin-1")):
            items.update(ids)
            first = int(np.searchsorted(starts, end - length + 1))
            yield first, first + n

    runs = joined(matches())
    if not runs:
        return len(words), [], items
    places = [m.span() for m in _WORD.finditer(data)]
    return len(words), [(a, b - a, places[a][0], places[b - 1][1]) for a, b in runs], items


def find_hits(docs: DataFrame, items: DataFrame, width: int = 13, text: str = "text", keep_text: bool = False, block: int = BLOCK) -> DataFrame:
    """Adds n_words, hits (runs of hit words and their places in the text) and items (ids of the items with a match). items: (item_id,
    text). A map for each block of patterns; texts are never shuffled."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    sc = docs.sparkSession.sparkContext
    new = [T.StructField("n_words", T.LongType()), T.StructField("hits", HITS), T.StructField("items", ITEMS)]
    rest = [c for c in docs.columns if c not in (text, *(f.name for f in new))]
    kept = [*rest, text]
    kinds = [to_arrow_type(f.dataType) for f in new]
    out = docs.select(*kept)
    for patterns in chain(pattern_blocks(items.select("item_id", "text"), width, block), [{}]):
        if not patterns and "hits" in out.columns:
            continue
        key = hashlib.sha1(repr(sorted(patterns.items())).encode()).hexdigest()
        shipped = sc.broadcast((key, patterns))
        first = "hits" not in out.columns

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped, first=first) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(shipped) if shipped.value[1] else None
            names = [f.name for f in HITS.elementType.fields]
            for batch in batches:
                column = lambda name, batch=batch: batch.column(batch.schema.get_field_index(name))
                found = []
                for i, t in enumerate(column(text)):
                    n, hits, ids = scan(t.as_py(), automaton)
                    if not first and (old := column("hits")[i].as_py()):  # of the blocks of patterns before
                        places = {(h["first_word"], h["first_word"] + h["words"]): h for h in old} | {(a, a + k): {"start_byte": s, "end_byte": e} for a, k, s, e in hits}
                        byte = {a: h["start_byte"] for (a, _), h in places.items()}, {b: h["end_byte"] for (_, b), h in places.items()}
                        hits = [(a, b - a, byte[0][a], byte[1][b]) for a, b in joined(sorted(places, key=lambda x: x[1]))]
                    if not first:
                        ids |= set(column("items")[i].as_py())
                    found.append((n, [dict(zip(names, h, strict=True)) for h in hits], sorted(ids)))
                yield pa.RecordBatch.from_arrays([*(column(c) for c in kept), *(pa.array([f[i] for f in found], k) for i, k in enumerate(kinds))], names=[*kept, *(f.name for f in new)])

        out = out.mapInArrow(run, T.StructType([docs.schema[c] for c in kept] + new))
    return out if keep_text else out.drop(text)


def with_verdict(hits: DataFrame, share: int = 20) -> DataFrame:
    """n_hit, n_items, items_sha256 and contaminated in place of the hits and the items."""
    added = {"n_hit", "n_items", "items_sha256", "contaminated"}
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda s, h: s + h["words"])
    ids = F.array_sort("items")
    return hits.select(
        *[c for c in hits.columns if c not in added | {"hits", "items"}],
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
    )
