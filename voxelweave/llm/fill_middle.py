"""Fill-in-middle transformation: texts cut at two places drawn by a hash, the pieces put in another order behind sentinels.

A unit grammar says which neighbouring characters stay together: pairs of character classes (left, right). Such a grammar is
translated to one zero-width regex, which holds between two characters that no pair joins (`boundary`); Spark's split at it keeps every
character, so the pieces are the units. As a boundary depends on its two neighbours alone, a text may be cut anywhere first: it is taken in
slices of SLICE characters, units are counted slice by slice, a slice that begins inside a unit counts one less, and only the slices that
hold a cut are split again for its place. No array of all units of a text is held, and all is column expressions.

Cases: a null text is an empty one, and an empty text, which split would make one piece, has no unit and is plain; a text that contains a
sentinel is plain; a null doc_id is hashed as an empty number; repeated rows are cut alike; long texts and long units are cut like any
other; other columns stay, but for those named like a result, which are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Character classes (as inside [...]) that stay together where the left one is followed by the right one.
GRAMMARS: dict[str, list[tuple[str, str]]] = {
    "char": [],
    "word": [("A-Za-z", "A-Za-z")],
    "led_word": [("A-Za-z", "A-Za-z"), (" ", "A-Za-z")],
    "line": [(r"^\n", r"\s\S")],
}
SENTINELS = ("<P>", "<S>", "<M>")
#: Characters of a slice.
SLICE = 1000


def boundary(joined: list[tuple[str, str]]) -> str:
    """The zero-width regex of all places between two characters that no pair of classes joins."""
    return "".join(f"(?!(?<=[{a}])(?=[{b}]))" for a, b in joined) + r"(?<=[\s\S])(?=[\s\S])"


def units(text: Column, regex: str) -> Column:
    """All pieces of a text; split gives one empty piece for an empty text, which has none."""
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.split(text, regex, -1))


def _counted(slices: Column, regex: str) -> Column:
    """For each slice: its number, its characters, 1 if it begins inside a unit, and the units that begin in it."""

    def one(slice_: Column, i: Column) -> Column:
        seam = F.concat(F.right(F.get(slices, i - 1), F.lit(1)), F.substring(slice_, 1, 1))
        inside = F.when((i > 0) & (F.size(F.split(seam, regex, -1)) == 1), 1).otherwise(0)
        return F.struct(i.alias("i"), F.length(slice_).alias("chars"), inside.alias("inside"), (F.size(F.split(slice_, regex, -1)) - inside).alias("begun"))

    return F.transform(slices, one)


def _place(cut: Column, n: Column, slices: Column, counted: Column, regex: str) -> Column:
    """Characters before unit number `cut` of n."""
    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("units"), zero.alias("chars"), F.lit(0).alias("i"), zero.alias("pieces"), zero.alias("before"))

    def step(done: Column, x: Column) -> Column:
        here = (done["units"] <= cut) & (cut < done["units"] + x["begun"])
        pick = lambda new, name: F.when(here, new.cast("long")).otherwise(done[name].cast("long"))
        return F.struct(
            (done["units"] + x["begun"]).alias("units"),
            (done["chars"] + x["chars"]).alias("chars"),
            pick(x["i"], "i").cast("int").alias("i"),
            pick(cut - done["units"] + x["inside"], "pieces").alias("pieces"),
            pick(done["chars"], "before").alias("before"),
        )

    def read(done: Column) -> Column:
        pieces = F.slice(F.split(F.get(slices, done["i"]), regex, -1), 1, done["pieces"].cast("int"))
        return F.when(cut >= n, done["chars"]).otherwise(done["before"] + F.length(F.array_join(pieces, "")))

    return F.when(cut <= 0, zero).otherwise(F.aggregate(counted, start, step, read))


def _drawn(key: Column, seed: int) -> Column:
    """Four unsigned 32-bit numbers from the hash of seed and key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)])


def transform(docs: DataFrame, grammar: str | list[tuple[str, str]] = "word", seed: int = 1, plain_percent: int = 10, spm_percent: int = 20, sentinels: tuple[str, str, str] = SENTINELS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with n (units), form (plain, psm or spm), prefix_chars and middle_chars (null if plain) and output."""
    firsts = [s[:1] for s in sentinels]
    if any(not s or s.count(s[0]) > 1 or (set(s[1:]) & set(firsts)) for s in sentinels) or len(set(sentinels)) < 3:
        raise ValueError("sentinels must be three, and their first characters may stand nowhere else in them")  # else a cut might make one
    regex = boundary(GRAMMARS[grammar] if isinstance(grammar, str) else grammar)
    p, s, m = (F.lit(x) for x in sentinels)
    new = ("n", "form", "prefix_chars", "middle_chars", "output")
    kept = [F.col(f"`{c}`").alias(f"_own{i}") for i, c in enumerate(docs.columns)]
    out = docs.select(*kept, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"), _drawn(F.col(key), seed).alias("_h"))
    out = out.withColumn("_slices", F.regexp_extract_all("_text", F.lit(rf"[\s\S]{{1,{SLICE}}}"), F.lit(0)))
    out = out.withColumn("_counted", _counted(F.col("_slices"), regex))
    out = out.withColumn("n", F.aggregate("_counted", F.lit(0).cast("long"), lambda a, x: a + x["begun"]))
    special = F.contains(F.col("_text"), p) | F.contains(F.col("_text"), s) | F.contains(F.col("_text"), m)
    plain = (F.col("n") == 0) | special | (F.col("_h")[2] % 100 >= 100 - plain_percent)
    out = out.withColumn("form", F.when(plain, "plain").when(F.col("_h")[3] % 100 < spm_percent, "spm").otherwise("psm"))
    cuts = [F.col("_h")[i] % (F.col("n") + 1) for i in range(2)]
    place = lambda cut: F.when(F.col("form") != "plain", _place(F.col(cut), F.col("n"), F.col("_slices"), F.col("_counted"), regex)).cast("int")
    out = out.withColumns({"_a": F.least(*cuts), "_b": F.greatest(*cuts)})
    out = out.withColumns({"_p1": place("_a"), "_p2": place("_b")})
    part = lambda a, b: F.substring(F.col("_text"), a + 1, b - a)
    prefix, middle = part(F.lit(0), F.col("_p1")), part(F.col("_p1"), F.col("_p2"))
    suffix = part(F.col("_p2"), F.length("_text"))
    output = F.when(F.col("form") == "plain", F.col("_text")).when(F.col("form") == "spm", F.concat(s, suffix, p, prefix, m, middle)).otherwise(F.concat(p, prefix, s, suffix, m, middle))
    own = [F.col(f"_own{i}").alias(c) for i, c in enumerate(docs.columns) if c not in new]
    return out.select(*own, "n", "form", F.col("_p1").cast("long").alias("prefix_chars"), (F.col("_p2") - F.col("_p1")).cast("long").alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output of this form was made from."""
    p, s, m = (F.lit(x) for x in sentinels)
    first, second = F.when(form == "spm", s).otherwise(p), F.when(form == "spm", p).otherwise(s)
    at = F.instr(output, second)
    rest = F.substring(output, at + F.length(second), F.length(output))
    mid = F.instr(rest, m)
    one, two = F.substring(output, F.length(first) + 1, at - F.length(first) - 1), F.substring(rest, F.lit(1), mid - 1)
    last = F.substring(rest, mid + F.length(m), F.length(rest))
    return F.when(form == "plain", output).when(form == "spm", F.concat(two, last, one)).otherwise(F.concat(one, last, two))


def digests(rows: DataFrame, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """rows of transform() with output_sha256 and restored_sha256 in place of the output."""
    back = rows.withColumns({"output_sha256": F.sha2("output", 256), "restored_sha256": F.sha2(restored(F.col("output"), F.col("form"), sentinels), 256)})
    return back.drop("output")
