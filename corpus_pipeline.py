"""A corpus pipeline: each stage is one operator of rollscan.llm, written as Parquet and read again as the next one's documents.

Every stage takes documents with any further columns, whatever their names, and all but the last return the same columns. Null
and empty texts, repeated rows and shared or missing doc_ids are told apart by row and text; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollscan.llm import bloom, exactdedup, mixing, ngramjoin, packing, toxicity
from rollscan.llm.common import held_out, stage, table
from rollscan.staging import scratch


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is 0.5 or more go; the classifier learns from the labelled documents among docs. Null and empty
    texts are scored by their lack of words. Repeated rows share their fate."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), held_out(5, 0))
    name = "toxicity"
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    clean = toxicity.score_documents(docs, model, name).filter(F.col(name) < 0.5)
    return clean.select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null is empty) one row stays: the one with the largest doc_id (a missing one only where no other has one); of
    rows that share that too, the one whose columns, in their order, are least (nulls first)."""
    copies = exactdedup.copies(stage(exactdedup.digests(docs), "digests"), keep="largest")
    copies = stage(copies.select(F.lower(F.hex("digest")).alias("sha256"), "keep_id", "ties"), "copied-texts")
    sha256 = F.sha2(F.coalesce("text", F.lit("")), 256)
    named = F.col("found.keep_id").eqNullSafe(F.col("row.doc_id"))
    rest = bloom.marked(docs, sha256, copies, "sha256").filter(F.col("found").isNull() | (named & (F.col("found.ties") == 1))).select("row.*")
    tied = copies.filter("ties > 1")
    if tied.isEmpty():
        return rest
    rows = bloom.marked(docs, sha256, tied, "sha256").filter(F.col("found").isNotNull() & named)
    return rest.unionByName(rows.groupBy(F.col("found.sha256")).agg(F.min("row").alias("row")).select("row.*"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the row with the smallest doc_id stays (a missing one last, the least hash of the
    text where rows share it). Texts without words have no duplicates; rows that repeat the one that stays do so too."""
    dropped = stage(ngramjoin.copies(docs), "dropped")
    return bloom.semi(docs, ngramjoin.row_key(F.col("doc_id"), F.xxhash64("text")), dropped, "dropped", keep=False)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes, as documents; see mixing.mixed_documents."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the mixed documents with their places in sequences; see packing.pack."""
    return packing.pack(docs, packing.default_tokenizer())


STAGES = [
    ("toxicity", reject_toxic),
    ("exact_dedup", drop_exact_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("source_mix", mix_sources),
    ("best_fit_packing", pack_sequences),
]
#: Learned scores, shingle components and token ids have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over the documents of sf_dir. A stage's own tables go once its result is written."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        with scratch(spark):
            docs = stage(step(spark, docs, sf_dir), name, lasting=True)
    return docs
