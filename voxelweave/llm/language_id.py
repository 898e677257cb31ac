"""Language identification by compression: the language whose dictionary makes a text smallest.

Each language has a zstandard raw-content dictionary cut from labelled texts. A text is encoded block by block with every dictionary;
the smallest total names the language, and the gap to the second smallest, as a share of it, is the margin. Texts under the asked
margin are marked rejected.

Cases: a null text, or one without a letter, is "und" with score 0; equal sizes go to the language with more labelled texts, then by name; without any
labelled text everything is "und"; repeated rows are judged each; a null id counts as not held out; other columns stay, names
clashing with the results excepted; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import hashlib
import re
import unicodedata
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bounds of the sample that dictionaries are cut from: texts for each language, characters of each, bytes of a dictionary, texts of all
#: languages together (of over 625 languages each gets fewer, but one at least).
SAMPLE_TEXTS, SAMPLE_CHARS, DICTIONARY_BYTES, SAMPLE_ALL = 96, 1500, 110_000, 60_000
#: Bytes of text that are encoded at once.
BLOCK = 4096

#: Text of these code points alone is cut by the standard library, which is faster; all other text by regex. Both ways cut alike.
NARROW = 0x250
_LETTERS = "".join(re.escape(c) for c in map(chr, range(NARROW)) if unicodedata.category(c)[0] in "LM")
_BEYOND = re.compile(f"[^\x00-{chr(NARROW - 1)}]").search
_NARROW = re.compile(f"[^{_LETTERS}]+")
_STATE: dict = {}


@functools.cache
def _wide():
    import regex

    return regex.compile(r"\p{L}").search, regex.compile(r"[^\p{L}\p{M}]+").sub


def has_letter(text: str) -> bool:
    """Whether a text has a letter; number letters and superscripts are none."""
    return bool(_wide()[0](text))


def held_out(doc_id: str = "doc_id", folds: int = 4, fold: int = 2):
    """Whether a document is kept from learning: crc32 of its id as text leaves the fold's remainder."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold, F.lit(False))


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> dict[str, bytes]:
    """A dictionary for each language of (key, text, lang) rows. Languages are counted over all rows; the sample takes those texts of
    each that come first by a hash of key and text, and a stretch of SAMPLE_CHARS from a hashed place in each."""
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    counts = rows.groupBy(lang).count().collect()  # a row for each language
    if not counts:
        return {}
    most = max(1, min(SAMPLE_TEXTS, SAMPLE_ALL // len(counts)))
    share = F.create_map(*[F.lit(x) for name, n in counts for x in (name, min(1.0, (1.3 * most + 8) / n))])
    place = F.pmod(F.xxhash64(F.lit(1), key, text), F.lit(1 << 40)) / float(1 << 40)
    start = 1 + F.pmod(F.xxhash64(F.lit(2), key, text), F.greatest(F.lit(1), F.length(text) - SAMPLE_CHARS)).cast("int")
    sample = rows.select(place.alias("p"), F.col(lang).alias("l"), F.substring(F.col(text), start, F.lit(SAMPLE_CHARS)).alias("t")).where(F.col("p") < share[F.col("l")])
    found = sample.orderBy("p", "l", "t").limit(3 * (most + 8) * len(counts)).collect()
    out = {}
    for name, _ in sorted(counts, key=lambda c: (-c[1], c[0])):  # the order breaks ties of size
        pieces = list(dict.fromkeys(r.t for r in found if r.l == name))
        if pieces:
            out[name] = "".join(map(plain, pieces[:most])).encode()[-DICTIONARY_BYTES:]
    return out


def plain(text: str) -> str:
    """Lower-case letters and the marks on them alone, so that case, markup and punctuation tell nothing."""
    text = text.lower()
    return (_wide()[1](" ", text) if _BEYOND(text) else _NARROW.sub(" ", text)).strip() + " "


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes], level: int):
        import zstandard

        self.names = list(dictionaries)
        self.encoders = []
        for name in self.names:
            data = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(level=level)
            self.encoders.append(zstandard.ZstdCompressor(level=level, dict_data=data, write_content_size=False, write_dict_id=False).compress)

    def sizes(self, text: str) -> list[int]:
        data = plain(text).encode()
        blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
        return [sum(len(encode(b)) for b in blocks) for encode in self.encoders]

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, margin)."""
        if not self.names or not text or not has_letter(text):
            return "und", 0.0, 0.0
        sizes = self.sizes(text)
        best = min(range(len(sizes)), key=sizes.__getitem__)
        others = [s for i, s in enumerate(sizes) if i != best]
        if not others:
            return self.names[best], 1.0, 1.0
        score = 1 / (1 + sum(2.0 ** -min(60.0, 8.0 * (s - sizes[best]) / 4) for s in others))
        return self.names[best], score, (min(others) - sizes[best]) / max(1, min(others))


def _classifier(shipped) -> Classifier:
    key, dictionaries, level = shipped.value
    if _STATE.get("key") != key:
        _STATE.update(key=key, classifier=Classifier(dictionaries, level))
    return _STATE["classifier"]


def predict(df: DataFrame, dictionaries: dict[str, bytes], text: str = "text", min_margin: float = 0.0, level: int = 3) -> DataFrame:
    """Adds lang_pred, score, margin and rejected. The dictionaries are broadcast; their size is bounded by the constants above."""
    import pyarrow as pa

    key = hashlib.sha1(repr((list(dictionaries.items()), level)).encode()).hexdigest()
    shipped = df.sparkSession.sparkContext.broadcast((key, dictionaries, level))
    new = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("margin", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    rest = [c for c in df.columns if c not in {f.name for f in new} | {text}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = _classifier(shipped)
        for batch in batches:
            column = lambda name, batch=batch: batch.column(batch.schema.get_field_index(name))
            found = [classifier.predict(t.as_py()) for t in column(text)]
            names, scores, margins = (pa.array([f[i] for f in found], k) for i, k in enumerate((pa.string(), pa.float64(), pa.float64())))
            rejected = pa.array([f[0] == "und" or f[2] < min_margin for f in found], pa.bool_())
            yield pa.RecordBatch.from_arrays([*(column(c) for c in rest), names, scores, margins, rejected], names=[*rest, *(f.name for f in new)])

    return df.select(*rest, text).mapInArrow(run, T.StructType([df.schema[c] for c in rest] + new))
