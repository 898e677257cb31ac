"""The corpus pipeline: five stages over documents, each written and reread before the next.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of documents.

Cases, for every stage: nulls in any column are kept as they are, and a null text is an empty one, which is of low quality, a copy of
nothing, and goes at the suffix-array stage as there is nothing left of it; ids that repeat, or are null, count as documents each, except
that the join of near copies keeps one row of a group of linked texts; extra columns stay, whatever their names; an empty table gives an
empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelweave.llm import byte_bpe, decontaminate, jaccard_join, quality, suffix_dedup
from voxelweave.llm.common import lookup, materialize, table


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, text and all other columns as one, so that no name of theirs meets one of an operator."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", (F.struct(*rest) if rest else F.lit(None).cast("boolean")).alias("own_columns"))


def _unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[F.col(c) if c in ("doc_id", "text") else F.col(f"own_columns.`{c}`") for c in docs.columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of low quality and toxic ones go."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return _unpacked(quality.judge(_packed(docs), model, keep_text=True).where("keep"), docs)


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of 0.75 and more over five-word shingles join, the one with the smallest id stays, one without an id only
    if none of them has one. Rows that share an id, or have none, but are not linked by their texts all stay."""
    marked = _packed(docs).withColumn("_mark", F.xxhash64("text"))
    linked = jaccard_join.linked_rows(marked, "_mark", width=5, percent=75)
    known = materialize(linked.where("NOT first OR _n > 1"), "near-copies")
    marked = marked.withColumn("_row", jaccard_join.row_key("doc_id", "_mark"))
    out = lookup(marked, known.withColumnRenamed("row", "_known"), "_row", "_known", docs.count())
    kept = out.where("first IS NULL")
    if known.where("first").limit(1).count():  # rows that repeat an id and text: one of them stays
        kept = kept.unionByName(out.where("first").dropDuplicates(["_row"]))
    return _unpacked(kept, docs)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes that start earlier too are cut out; cut characters lose what is left of them, and documents with nothing
    left but white space go. n_chars follows the text."""
    kept = suffix_dedup.remove_repeats(_packed(docs).where("text IS NOT NULL"), length=100, whole=True, carry=["own_columns"], keep_bytes=False)
    out = _unpacked(kept.withColumn("text", F.col("kept_text")), docs).where(F.col("text").rlike(r"\S"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    hits = decontaminate.find_hits(_packed(docs), table(spark, sf_dir, "benchmark"), width=13, keep_text=True)
    return _unpacked(decontaminate.with_verdict(hits).where("NOT contaminated"), docs)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, decoded again for proof: digests as in op5."""
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = byte_bpe.encode(docs.select("doc_id", "text"), path, pattern)
    return byte_bpe.digests(byte_bpe.decode(encoded, path, pattern))


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_copies_stage),
    ("suffix-array dedup", repeats_stage),
    ("benchmark decontamination", decontaminate_stage),
    ("byte-level BPE", tokens_stage),
]

#: SQL can express neither the classifier nor the tokenizer; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
