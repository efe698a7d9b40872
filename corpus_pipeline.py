"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

The last stage returns (doc_id, ids, n_pieces, round_trip); all others return the columns of documents. SQL cannot
express the suffix array, the mixture's seeded hash order or the tokenizer, so ORACLE_SQL is None and tests compare the
stages with brute force.

All stages take tables with further columns, which they keep (encode leaves only its own), whatever their names, dots and
names of internal columns included; an empty table gives an empty result. Rows that repeat are rows of their own, but for what a stage says of copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._common import arrow_rows, read, written
from tidemark.llm.exact_dedup import exact_dedup, text_sha256
from tidemark.llm.jaccard import jaccard_join, text_key
from tidemark.llm.mixing import WEIGHTS, mix_sources
from tidemark.llm.pieces_codec import piece_encode
from tidemark.llm.quality import quality_filter

#: Tokens that the mixture takes, as a share of those that reach it; no row is taken twice.
SHARE = 0.9


def _keyed(docs: DataFrame, key: Column) -> DataFrame:
    """Each row of docs as one struct, so that no name of its columns can clash, and a value for its id and its text's key; a
    missing id is a value like others."""
    pair = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), key)
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), pair.alias("pair"))


def _keep(docs: DataFrame, key: Column, chosen: DataFrame, chosen_key: Column) -> DataFrame:
    """The keyed rows of docs whose id and text (by its key) are in chosen."""
    return _keyed(docs, key).join(_keyed(chosen, chosen_key).select("pair"), "pair", "left_semi")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality rules reject: null and empty texts, which have no words, among them. Ids play no
    part."""
    arrow_rows(spark)
    return quality_filter(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z folded) the smallest doc_id stays; of rows that repeat it with equal text, or that have no id
    anywhere, the smallest by the values of their columns in turn (nulls first; by their JSON, where maps have no order)."""
    arrow_rows(spark)
    kept = exact_dedup(docs, keep="smallest").filter("kept")
    rows = _keep(docs, text_sha256(F.col("text")), kept, F.col("text_sha256"))
    first = F.min("row") if "map<" not in docs.schema.simpleString() else F.min_by("row", F.to_json("row"))
    return rows.groupBy("pair").agg(first.alias("row")).select("row.*")  # where the join has put them already


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked documents the smallest doc_id stays, with all texts that it has there; documents without
    an id stay where no linked one has an id."""
    arrow_rows(spark)
    kept = jaccard_join(docs, keyed=True).filter("doc_id <=> component_id")
    return _keep(docs, F.hex(text_key(F.col("text"))), kept, F.hex("text_key")).select("row.*")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each leaf's token budget in seeded order, no row more than once. Null lang and source count as 'none', null ids as
    one id; rows that repeat an id are taken or left together; texts without words are taken with what precedes them."""
    return mix_sources(docs, SHARE, weights=WEIGHTS, max_epochs=1)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document that is left, one row a row; null ids stay null, null texts have no ids."""
    arrow_rows(spark)
    return piece_encode(docs)


STAGES = [("quality rules", quality), ("exact dedup", exact), ("n-gram Jaccard join", near), ("source mixing", mixing), ("SentencePiece encoding", encode)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, writing each one's rows to the shared folder before the next."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
