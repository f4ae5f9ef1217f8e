"""A training corpus from raw documents: five stages, each stored before the next.

language ID -> line dedup -> near-dedup -> mixing -> packing

A stage gets what its predecessor kept and, but for the last, returns the columns
of ``documents``, and any further ones, whatever their names. Null texts have no
language and leave at the first stage; of rows that repeat a document one stays at
the third, with an id or without; rows with one id and unlike texts are documents
of their own. An empty table runs through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peerglass.llm import langid, line_dedup, minhash, mixing, packing
from peerglass.llm.queries import label_quality, trains
from peerglass.sources.tables import durable


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; texts without letters and narrow margins go."""
    known = docs.where(trains())
    model = langid.learn(known)
    margin = langid.narrow_margin(known, model)
    found = docs.select(F.struct("*").alias("row"), langid.classify(docs, model, min_margin=margin).alias("found"))
    return found.where("found.accepted").select("row.*")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without recurring lines; documents of nothing but those go."""
    others = F.struct(*(c for c in docs.columns if c != "text"))
    cut = line_dedup.drop_recurring_lines(docs.select(others.alias("row"), "doc_id", "text"), lead_counts=False)
    left = cut.where((F.col("n_dropped") == 0) | F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return left.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: five-word shingles, similarity 0.8 or more.

    Rows are told apart by a number of their own, stored with them, so that a text
    is never taken for another with its id. Of a group the least id stays, and of
    rows with that id the first; rows without an id come last.
    """
    rows = durable(
        docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("nth")), "pipeline-rows"
    )
    texts = rows.select("nth", F.col("row.text").alias("text"))
    found = minhash.near_duplicates(texts, words=5, threshold=80, id_col="nth")
    ids = rows.select("nth", F.col("row.doc_id").alias("id"))
    kept = (
        found.select(F.col("doc_id").alias("nth"), F.col("component_id").alias("group"))
        .join(ids, "nth")
        .groupBy("group")
        .agg(F.min(F.struct(F.col("id").isNull(), "id", "nth"))["nth"].alias("nth"))
    )
    return rows.join(kept, "nth", "left_semi").select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.apply_mix(docs, mixing.mix(docs, quality=label_quality(spark, sf_dir)))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", drop_lines),
    ("minhash_near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("mixture_packing", pack_windows),
]

# No SQL states compression sizes, MinHash bands or a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
