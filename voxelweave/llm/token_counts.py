"""Exact token counts at every prefix by dynamic programming over a byte-level BPE vocabulary.

For a pre-token, position i holds the last token of the encoding of its first i bytes and the number of tokens up to there. Exactly
one token that ends at i follows the last token at its own start in a way that merging would leave alone, so each position needs only
lookups; the count at every prefix comes with the whole. A worker keeps these arrays by distinct pre-token; a text's count adds up
those of its pre-tokens, and budget or truncation questions read the arrays instead of encoding again.

Cases: a null text counts as empty (0 tokens, 0 bytes); repeated rows are counted each; other columns, nulls in them included, stay,
names clashing with the results excepted; an empty table gives an empty table. Texts may be of any length. Special strings of the tokenizer in a text
count as one token, as in the library's default.
"""

from __future__ import annotations

import json
from array import array
from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelweave.llm.byte_bpe import byte_alphabet, splitter

#: Distinct pre-tokens (and pairs of tokens) a worker remembers; beyond that it starts anew. Speed only.
MEMORY = 400_000
#: The pre-token pattern that a byte-level pre-tokenizer with use_regex stands for: fixed value of the format.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_STATE: dict = {}


class Totals(dict):
    """The last entry of each pre-token's array, worked out when first asked for."""

    def __init__(self, counter: PrefixCounter):
        super().__init__()
        self.counter = counter

    def __missing__(self, piece: str) -> int:
        if len(self) >= MEMORY:
            self.clear()
        n = self[piece] = self.counter.arrays(piece)[-1]
        return n


class PrefixCounter:
    """Counts on one worker."""

    def __init__(self, path: str):
        import re

        import regex
        from tokenizers import pre_tokenizers

        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        back = {c: b for b, c in enumerate(byte_alphabet())}
        as_bytes = lambda word: bytes(back[c] for c in word)
        model = held["model"]
        merges = [tuple(map(as_bytes, m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
        made = {a + b for a, b in merges}
        base = [w for w in map(as_bytes, model["vocab"]) if w not in made]
        if len(made) != len(merges) or any(len(w) > 1 for w in base):
            raise ValueError("every token of more than one byte must come from one merge")
        #: Tokens by the order of their merges, single bytes first; a single byte's parts are itself.
        self.ids = {w: i for i, w in enumerate(base)} | {a + b: len(base) + i for i, (a, b) in enumerate(merges)}
        self.parts = [(i, i) for i in range(len(base))] + [(self.ids[a], self.ids[b]) for a, b in merges]
        self.merge = {pair: len(base) + i for i, pair in enumerate(self.parts[len(base) :])}
        self.ends = {w[i:] for w in self.ids for i in range(len(w))}
        special = tuple(sorted((x["content"] for x in held["added_tokens"]), key=len, reverse=True))
        self.special_strings = special
        self.special = regex.compile("|".join(map(regex.escape, special))).split if special else lambda text: [text]
        self.split = splitter(PATTERN)
        self.library = pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str
        self.odd = re.compile("[^\x00-\u0557]").findall
        self.same: dict[str, bool] = {}
        self.edges: tuple[dict, dict] = {}, {}
        self.stays: dict[tuple[int, int], bool] = {}
        self.table: dict[str, array] = {}
        self.totals = Totals(self)

    def edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens that stand at one side of a token while merging builds it, each with the rank at which it becomes part of the
        next; the token itself stays."""
        found = self.edges[side].get(token)
        if found is None:
            inner = self.parts[token][side]
            found = [(token, len(self.parts))] if inner == token else [(token, len(self.parts)), (inner, token), *self.edge(inner, side)[1:]]
            self.edges[side][token] = found
        return found

    def follows(self, a: int, b: int) -> bool:
        """Whether merging leaves the border between tokens a and b alone. Replays both: a merge across the border happens if its rank
        comes while both neighbours of the border stand. Equal ranks merge from the left."""
        for left, left_goes in self.edge(a, 1):
            for right, right_goes in self.edge(b, 0):
                rank = self.merge.get((left, right))
                if rank is not None and rank < left_goes and rank <= right_goes:
                    return False
        return True

    def prefix_counts(self, data: bytes) -> array:
        """Tokens of data[:i] for i from 0 to its length."""
        last, counts, ids, ends, stays = [-1], array("i", [0]), self.ids, self.ends, self.stays
        for end in range(1, len(data) + 1):
            for start in range(end - 1, -1, -1):
                word = data[start:end]
                if word not in ends:
                    raise ValueError("no token follows: the vocabulary lacks a byte")
                if (b := ids.get(word)) is None:
                    continue
                if start:
                    a = last[start]
                    if (found := stays.get((a, b))) is None:
                        if len(stays) >= MEMORY:
                            stays.clear()
                        found = stays[a, b] = self.follows(a, b)
                    if not found:
                        continue
                last.append(b)
                counts.append(counts[start] + 1)
                break
        return counts

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens; where this pattern's Unicode tables differ from the library's, the library cuts the text."""
        for c in set(self.odd(text)):
            if c not in self.same:
                probe = f"a{c}1{c}!"
                cuts, cut = [], 0
                for m in self.split(probe):
                    cuts.append((cut, cut := cut + len(m)))
                self.same[c] = cuts == [span for _, span in self.library(probe)]
            if not self.same[c]:
                return [text[a:b] for _, (a, b) in self.library(text)]
        return self.split(text)

    def arrays(self, piece: str) -> array:
        found = self.table.get(piece)
        if found is None:
            if len(self.table) >= MEMORY:
                self.table.clear()
            found = self.table[piece] = self.prefix_counts(piece.encode())
        return found

    def count(self, text: str) -> int:
        parts = self.special(text)
        return sum(sum(map(self.totals.__getitem__, self.pieces(part))) for part in parts) + len(parts) - 1

    def boundaries(self, text: str) -> tuple[list[int], list[int]]:
        """Ends of pre-tokens (and special strings) in characters, and the tokens up to each."""
        ends, counts, at, n = [0], [0], 0, 0
        parts = self.special(text)
        for k, part in enumerate(parts):
            if k:  # the special string between two parts
                at = ends[-1] + len(self._special_at(text, ends[-1]))
                n += 1
                ends.append(at)
                counts.append(n)
            for piece in self.pieces(part):
                at += len(piece)
                n += self.arrays(piece)[-1]
                ends.append(at)
                counts.append(n)
        return ends, counts

    def _special_at(self, text: str, at: int) -> str:
        return next(s for s in self.special_strings if text.startswith(s, at))

    def fit(self, text: str, budget: int) -> int:
        """Characters of the longest prefix that ends at a character and whose own encoding has at most so many tokens, among the
        prefixes up to the first pre-token that doesn't fit whole. Read from that pre-token's array, without encoding again."""
        ends, counts = self.boundaries(text)
        k = bisect_right(counts, budget) - 1
        while k + 1 < len(ends) and counts[k + 1] <= budget:
            k += 1
        if k + 1 == len(ends):
            return len(text)
        piece = text[ends[k] : ends[k + 1]]
        if piece in self.special_strings:
            return ends[k]
        left = budget - counts[k]
        if piece[0] == "'":  # the one kind of pre-token whose beginnings may be cut otherwise; three characters at most, or signs
            return ends[k] + max(n for n in range(len(piece)) if sum(self.arrays(p)[-1] for p in self.pieces(piece[:n])) <= left)
        by_byte, at, best = self.arrays(piece), 0, 0
        for n, c in enumerate(piece[:-1], 1):
            at += len(c.encode())
            if by_byte[at] <= left:
                best = n
        return ends[k] + best


def _counter(path: str) -> PrefixCounter:
    if _STATE.get("path") != path:
        _STATE.update(path=path, counter=PrefixCounter(path))
    return _STATE["counter"]


def _mapped(df: DataFrame, path: str, text: str, out: T.StructField, of) -> DataFrame:
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    rest = [c for c in df.columns if c != out.name]
    kind = to_arrow_type(out.dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            values = [of(counter, t.as_py() or "") for t in texts]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in rest), pa.array(values, kind)], names=[*rest, out.name])

    return df.select(*rest).mapInArrow(run, T.StructType([df.schema[c] for c in rest] + [out]))


def count_tokens(df: DataFrame, path: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """Adds the exact token count of each whole text."""
    return _mapped(df, path, text, T.StructField(out, T.LongType(), False), lambda counter, t: counter.count(t))


def prefix_table(df: DataFrame, path: str, text: str = "text", out: str = "prefix_tokens") -> DataFrame:
    """Adds (end in characters, tokens up to there) for every pre-token boundary of each text."""
    kind = T.ArrayType(T.StructType([T.StructField("chars", T.IntegerType()), T.StructField("tokens", T.IntegerType())]))
    return _mapped(df, path, text, T.StructField(out, kind, False), lambda counter, t: [{"chars": a, "tokens": b} for a, b in zip(*counter.boundaries(t), strict=True)])


def truncate_to_budget(df: DataFrame, path: str, budget: int, text: str = "text", out: str = "kept_chars") -> DataFrame:
    """Adds how many characters of each text fit a budget of tokens."""
    return _mapped(df, path, text, T.StructField(out, T.IntegerType(), False), lambda counter, t: counter.fit(t, budget))


def with_lengths(df: DataFrame, limit: int, text: str = "text") -> DataFrame:
    """n_bytes and over_limit beside n_tokens, in place of the text."""
    return df.select(
        *[c for c in df.columns if c not in (text, "n_tokens", "n_bytes", "over_limit")],
        F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > limit).alias("over_limit"),
    )
