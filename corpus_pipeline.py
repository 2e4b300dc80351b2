"""A pipeline over documents: quality, line, near-duplicate and benchmark stages, then tokens.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; all but the last return the columns of
documents. Stages are written as Parquet and read again, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.llm import decontamination, jaccard_join, line_dedup, quality, sentencepiece_codec
from rillflow.llm._spark import load, table
from rillflow.llm.queries import tokenizer_path

#: Documents whose quality score is below this go.
LEAST_QUALITY = 0.3


def whole(docs: DataFrame, stage) -> DataFrame:
    """docs' columns of the rows that stage returns. It gets doc_id, text and the whole row as one column, so no name can clash."""
    rows = docs.select(F.col("doc_id"), F.col("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return stage(rows).select("row.*")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject. It is fitted on the labelled documents of its input."""
    model = quality.fit(docs, load(spark, sf_dir, "labels"))
    return whole(docs, lambda rows: quality.score(rows, model, ["row"]).filter(F.col("score") >= LEAST_QUALITY))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier line is near to, or, if short, equal to; one that had lines and keeps none goes."""

    def lines(rows: DataFrame) -> DataFrame:
        out = line_dedup.line_dedup(rows, keep=["row"], short=True).filter((F.col("n_lines") == 0) | (F.col("n_removed") < F.col("n_lines")))
        cut = F.col("row").withField("text", F.col("kept"))
        if "n_chars" in docs.columns:
            cut = cut.withField("n_chars", F.length("kept").cast(docs.schema["n_chars"].dataType))
        return out.select(F.when(F.col("n_removed") > 0, cut).otherwise(F.col("row")).alias("row"))

    return whole(docs, lines)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of rows that links of 5-word shingles at 0.8 join, exactly one stays: that with the smallest doc_id, null
    last, and of several the one with the smallest hash of its columns. Rows without a word all stay."""
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text", F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns], *(F.col(f"`{c}`").isNull() for c in docs.columns)).alias("key"))
    found = jaccard_join.jaccard_components(own, shingle=5, limit=jaccard_join.Threshold(80, 100), doc_id="key")
    groups = found.filter("n_shingles > 0").groupBy(F.col("doc_id").alias("key"), "component_id").agg(F.count(F.lit(1)).alias("n"))
    places = own.select("key", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key").alias("place")).distinct()
    placed = table(groups.join(places, "key"), "copies")
    first = placed.groupBy("component_id").agg(F.min("place").alias("first"))
    # rows alike in all columns have one hash: those that stay are read by themselves and made one
    marked = table(placed.join(first, "component_id").select("key", "n", (F.col("first.key") != F.col("key")).alias("gone")).filter("gone or n > 1"), "marked")
    stay = own.join(marked.select("key"), "key", "left_anti").select("row.*")
    once = own.join(marked.filter("not gone").select("key"), "key", "left_semi").dropDuplicates(["key"]).select("row.*")
    return stay.union(once)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words fewer than a twentieth lie in benchmark windows."""
    return whole(docs, lambda rows: decontamination.decontaminate(rows, load(spark, sf_dir, "benchmark"), keep=["row"]).filter("not contaminated"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit, with begin and end), n_tokens, and whether they decode to the text."""
    out = sentencepiece_codec.encode_decode(docs, tokenizer_path(), keep=("doc_id", "text"))
    return out.select("doc_id", "ids", "n_tokens", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("SentencePiece encoding", encode),
]

#: The classifier's scores and the tokenizer can't be said in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
