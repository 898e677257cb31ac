"""Quality and toxicity of texts: a weak-label model over heuristic labellers, whose posteriors train a hashed linear scorer.

Labellers vote bad, good or abstain on the texts of a bounded sample; they overlap and err. Ratings from the labels table are one more
labeller where there are any. Expectation-maximisation estimates how often each labeller votes what on bad and on good texts, and with
that the posterior of every sample text. A linear scorer over hashed features learns the posteriors and then judges every whole text.

Cases: a null text, or one without words, is of low quality and not toxic; nulls in ratings abstain; several ratings of one id count
as their worst; ratings without a text are ignored; without any rating the heuristics decide alone; repeated rows are judged each;
other columns stay, names clashing with the results excepted; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelweave.llm.common import give_back

#: Bounds of the fitting sample: rated texts, other texts, and characters of a text that is taken into it.
RATED, OTHERS, SAMPLE_CHARS = 6000, 1500, 20_000
#: Buckets of the hashed features.
WIDTH = 1 << 18
#: Words a worker remembers. Speed only.
MEMORY = 150_000

#: Insults of the toxicity heuristic: fixed values, alphabetical.
INSULTS = frozenset("clown disgusting idiot loser moron pathetic scum stupid trash worthless".split())

_WORD = re.compile(r"[^\W\d_]+")
_SYMBOLS = [ord(c) for c in "#$%&*|!<>{}[]\\~^=+@"]
_STATE: dict = {}


def bucket(feature: str) -> int:
    return zlib.crc32(feature.encode()) % WIDTH


def word_buckets(word: str) -> set[int]:
    """A word and its beginnings."""
    return {bucket(f"w:{word}")} | {bucket(f"p:{word[:n]}") for n in range(3, min(8, len(word) + 1))}


def words_of(text: str) -> Counter:
    return Counter(_WORD.findall(text.lower()))


def measures(text: str, words: Counter) -> dict[str, float]:
    """What the quality heuristics look at, over the whole text."""
    n = words.total()
    if not n:
        return {}
    of = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    upper, lower, wide = int(of[0x41:0x5B].sum()), int(of[0x61:0x7B].sum()), int(of[0xC0:].sum())
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    return {
        "tokens": float(n),
        "symbols": int(of[_SYMBOLS].sum()) / n,
        "shouting": upper / max(1, upper + lower),
        "distinct": len(words) / n,
        "top": max(words.values()) / n,
        "pipes": int(of[0x7C]) / n,
        "lines": 1 - len(set(lines)) / max(1, len(lines)),
        "length": (upper + lower + wide) / n,
    }


def _vote(x: float | None, bad, good) -> int:
    return -1 if x is None else 1 if bad(x) else 0 if good(x) else -1


#: The quality labellers in the order of their votes.
LABELLERS = ("symbols", "shouting", "distinct", "top", "pipes", "lines", "length", "rating")


def quality_votes(m: dict[str, float], rating: int | None) -> list[int]:
    """Votes of the quality labellers: 1 bad, 0 good, -1 abstains. The rating's is the last."""
    long = m.get("tokens", 0) >= 20
    return [
        _vote(m.get("symbols"), lambda x: x > 0.35, lambda x: x < 0.1),
        _vote(m.get("shouting"), lambda x: x > 0.5, lambda x: x < 0.2),
        _vote(m.get("distinct") if long else None, lambda x: x < 0.12, lambda x: x > 0.4),
        _vote(m.get("top") if long else None, lambda x: x > 0.35, lambda x: x < 0.15),
        _vote(m.get("pipes"), lambda x: x > 0.2, lambda x: x < 0.02),
        _vote(m.get("lines") if m.get("tokens", 0) >= 40 else None, lambda x: x > 0.6, lambda x: x < 0.2),
        _vote(m.get("length"), lambda x: x < 1.5 or x > 20, lambda x: 3 < x < 12),
        -1 if rating is None else 1 - int(rating > 0),
    ]


def quality_buckets(m: dict[str, float]) -> set[int]:
    """Each measure in steps, as hashed features."""
    if not m:
        return {bucket("q:none")}
    step = lambda k, x: int(min(12, max(0, round(6 + 2 * math.log2(x / 0.1)) if x > 0 else 0)))
    out = {f"q:{k}:{step(k, x)}" for k, x in m.items() if k not in ("tokens", "length")}
    out |= {f"q:length:{min(24, round(m['length']))}"}
    return {bucket(f) for f in out}


def em(votes: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of bad for each row of votes (1, 0, -1), the labellers' vote rates by class (class, labeller, vote), and the share
    of bad. Starts from the majority; a labeller is taken to be better than chance."""
    said = np.stack([votes == v for v in (0, 1, -1)], 2).astype(float)
    bad, good = (votes == 1).sum(1), (votes == 0).sum(1)
    q = np.clip((2 * bad + 0.1) / (2 * bad + good + 0.6), 0.02, 0.98)
    for _ in range(rounds):
        share = np.clip(q.mean(), 1e-3, 1 - 1e-3) if len(q) else 0.5
        rates = np.stack([(w[:, None, None] * said).sum(0) + 0.5 for w in (1 - q, q)])
        rates /= rates.sum(2, keepdims=True)
        rates[1, :, 1] = np.maximum(rates[1, :, 1], rates[0, :, 1])
        odds = (said * (np.log(rates[1]) - np.log(rates[0]))).sum((1, 2)) + math.log(share / (1 - share))
        q = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return q, rates, float(share)


def train(features: list[np.ndarray], q: np.ndarray, chosen: np.ndarray | None = None, rounds: int = 800, decay: float = 5e-5) -> tuple[np.ndarray, float]:
    """Weights by bucket, and the bias, of a logistic scorer for soft labels; only chosen buckets get a weight."""
    rows = np.repeat(np.arange(len(features)), [len(f) for f in features])
    cols = np.concatenate([*features, np.zeros(0, np.int32)]).astype(np.int64)
    if chosen is not None:
        rows, cols = rows[chosen[cols]], cols[chosen[cols]]
    used, cols = np.unique(cols, return_inverse=True)
    w, bias = np.zeros(len(used)), 0.0
    g2, b2 = np.full(len(used), 1e-8), 1e-8
    n = max(1, len(features))
    for _ in range(rounds):
        z = bias + np.bincount(rows, w[cols], len(features))
        r = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - q) / n
        g = np.bincount(cols, r[rows], len(used)) + decay * w
        g2 += g * g
        w -= 0.3 * g / np.sqrt(g2)
        b2 += r.sum() ** 2
        bias -= 0.3 * r.sum() / math.sqrt(b2)
    out = np.zeros(WIDTH, np.float32)
    out[used] = w
    return out, float(bias)


def telling(features: list[np.ndarray], q: np.ndarray, least: int, share: float) -> np.ndarray:
    """Buckets whose texts are bad by at least this share, smoothed, and that enough texts hold."""
    n, p = np.zeros(WIDTH), np.zeros(WIDTH)
    for f, x in zip(features, q, strict=True):
        n[f] += 1
        p[f] += x
    return (n >= least) & (p / (n + 1) >= share)


def fit(docs: DataFrame, ratings: DataFrame | None, text: str = "text", key: str = "doc_id") -> dict:
    """The model, on the driver, from a sample whose size the constants bound: the first texts in the order of a hash, so each fit of the
    same tables takes the same."""
    place = lambda seed, *columns: F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 40)) / float(1 << 40)
    total = docs.count()
    rows: list[tuple] = []
    if ratings is not None:
        rated = ratings.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
        n = max(1, rated.count())
        picked = rated.withColumn("_p", place(3, "_k")).where(F.col("_p") < (1.2 * RATED + 100) / n).orderBy("_p", "_k").limit(RATED)
        found = docs.join(F.broadcast(picked), F.col(key) == F.col("_k"))  # at most RATED rows are broadcast
        found = found.where(F.length(text) <= SAMPLE_CHARS).orderBy("_p", F.xxhash64(text)).select(text, "quality", "toxic")
        rows = [tuple(r) for r in found.limit(RATED).collect()]
    others = docs.where(F.length(text) <= SAMPLE_CHARS).select(text, place(4, key, text).alias("_p")).where(F.col("_p") < (1.2 * OTHERS + 100) / max(1, total))
    rows += [(r[0], None, None) for r in others.orderBy("_p", text).limit(OTHERS).collect()]
    rows = sorted({(t, q, x) for t, q, x in rows if t}, key=lambda r: zlib.crc32(r[0].encode()))
    words = [words_of(t) for t, _, _ in rows]
    measured = [measures(t, w) for (t, _, _), w in zip(rows, words, strict=True)]
    if not rows:
        return {"quality": (np.zeros(WIDTH, np.float32), -1.0), "toxic": (np.zeros(WIDTH, np.float32), -1.0), "accuracies": {}}
    votes = np.array([quality_votes(m, q) for m, (_, q, _) in zip(measured, rows, strict=True)])
    low, low_rates, low_share = em(votes)
    quality = train([np.fromiter(quality_buckets(m), np.int32) for m in measured], low)
    features = [np.unique(np.fromiter((b for w in ws for b in word_buckets(w)), np.int32)) for ws in words]
    rated = np.array([-1 if x is None else int(x > 0) for _, _, x in rows])
    insult = np.array([1 if INSULTS & ws.keys() else -1 for ws in words])
    columns = [insult, rated]
    side = np.array([zlib.crc32(t[-400:].encode()) % 2 for t, _, _ in rows])  # texts with one end are one text's copies
    for half in (0, 1):  # terms that the ratings of one half tell of, as a labeller of the other
        mine = np.nonzero((side == half) & (rated >= 0))[0]
        terms = telling([features[i] for i in mine], rated[mine].astype(float), 8, 0.9)
        columns.append(np.array([-1 if x == half or not terms.any() else int(terms[f].any()) for x, f in zip(side, features, strict=True)]))
    bad, bad_rates, bad_share = em(np.stack(columns, 1))
    toxic = train(features, bad, telling(features, bad, 5, 0.8))
    return {"quality": quality, "toxic": toxic, "accuracies": {"labellers": LABELLERS, "quality": low_rates, "quality_share": low_share, "toxic": bad_rates, "toxic_share": bad_share}}


class Known(dict):
    """A word's part of the toxicity score, worked out when first asked for."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) >= MEMORY:
            self.clear()
        x = self[word] = float(sum(self.weights[b] for b in word_buckets(word)))
        return x


class Scorer:
    def __init__(self, model: dict):
        self.quality, self.quality_bias = model["quality"]
        self.toxic, self.toxic_bias = model["toxic"]
        self.known = Known(self.toxic)

    def score(self, text: str | None) -> tuple[float, float]:
        """Probabilities of low quality and of toxicity."""
        words = words_of(text or "")
        m = measures(text or "", words)
        if not m:
            return 1.0, 0.0
        low = self.quality_bias + float(sum(self.quality[b] for b in quality_buckets(m)))
        bad = self.toxic_bias + sum(map(self.known.__getitem__, words))
        logistic = lambda z: 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
        return logistic(low), logistic(bad)


def judge(docs: DataFrame, model: dict, threshold: float = 0.5, text: str = "text", keep_text: bool = False) -> DataFrame:
    """Adds low_quality, toxicity (probabilities) and keep. The model's size is fixed by WIDTH."""
    import pyarrow as pa

    shipped = docs.sparkSession.sparkContext.broadcast({k: model[k] for k in ("quality", "toxic")})
    new = [T.StructField("low_quality", T.DoubleType()), T.StructField("toxicity", T.DoubleType()), T.StructField("keep", T.BooleanType())]
    rest = [c for c in docs.columns if c not in {f.name for f in new} | (set() if keep_text else {text})]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if _STATE.get("key") is not shipped:
            _STATE.update(key=shipped, scorer=Scorer(shipped.value))
        scorer = _STATE["scorer"]
        for batch in batches:
            column = lambda name, batch=batch: batch.column(batch.schema.get_field_index(name))
            found = [scorer.score(t.as_py()) for t in column(text)]
            values = [pa.array([f[i] for f in found], pa.float64()) for i in (0, 1)]
            give_back()
            keep = pa.array([f[0] <= threshold and f[1] <= threshold for f in found], pa.bool_())
            yield pa.RecordBatch.from_arrays([*(column(c) for c in rest), *values, keep], names=[*rest, *(f.name for f in new)])

    return docs.select(*dict.fromkeys([*rest, text])).mapInArrow(run, T.StructType([docs.schema[c] for c in rest] + new))
