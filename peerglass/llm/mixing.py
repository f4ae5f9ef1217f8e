"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source gets a token budget: its share of all tokens by weight, at most
``most_epochs`` times what it has; what a source cannot take goes to the others
by weight until none is above. A source passes through all its documents as often
as the budget holds them (complete epochs). The rest of the budget is filled
from documents in order of exponential keys ``-ln(u) / quality`` - drawing without
replacement with chances in proportion to quality - whose sizes are prefix-summed;
the last document is taken if that brings the source nearer its budget.

``u`` is a hash of seed and document id: reruns agree, whatever the partitions.

Defined results: null text has size 0; a null source is a source of its own, after
all others; documents without quality, or with one that is null or not positive,
count with quality 1; rows that repeat an id are separate documents with equal
keys; an empty table gives an empty result. Sources are sorted by code point.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peerglass.llm.prefix import join_same, running_totals
from peerglass.sources.tables import durable

WORD = "[^\\x20\\x09-\\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def budgets(sources: DataFrame, weights: Sequence[float], most_epochs: int) -> DataFrame:
    """(source, source_size, target) from a row per source.

    With sources in order of how soon they reach their cap, the capped ones come
    first, so running sums over them give the level that the others share.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    place = (F.row_number().over(by_name) - 1) % len(weights)
    pattern = F.array(*(F.lit(float(w)) for w in weights))
    rows = sources.select(
        "source",
        "source_size",
        F.element_at(pattern, (place + 1).cast("int")).alias("weight"),
        (F.col("source_size") * most_epochs).cast("double").alias("cap"),
    )
    everything = Window.partitionBy()
    soonest = Window.orderBy(
        F.col("cap") / F.col("weight"), F.col("source").isNull(), "source"
    ).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn(
        "level",
        (
            F.sum("source_size").over(everything).cast("double")
            - F.coalesce(F.sum("cap").over(soonest), F.lit(0.0))
        )
        / (
            F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(soonest), F.lit(0.0))
        ),
    )
    capped = F.col("cap") <= F.col("level") * F.col("weight")
    rows = rows.withColumn("capped", capped)
    level = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(
        everything
    )
    return rows.select(
        "source",
        "source_size",
        F.when(F.col("capped"), F.col("cap")).otherwise(level["level"] * F.col("weight")).alias("target"),
    )


def mix(
    documents: DataFrame,
    *,
    weights: Sequence[float] = (1, 2, 3),
    most_epochs: int = 3,
    quality: DataFrame | None = None,
    seed: str = "mix",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """A row per document: how often the mix takes it.

    ``quality`` has columns (doc_id, quality), a row per id. Returns doc_id,
    nth (number among rows that repeat the id), size, source_size, target,
    copies, taken.
    """
    docs = documents.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        word_count(F.col(text_col)).alias("size"),
        F.xxhash64(text_col).alias("_text"),
    )
    if quality is None:
        docs = docs.withColumn("quality", F.lit(1.0))
    else:
        known = quality.select(
            F.col("doc_id").alias("_id"), F.col("quality").cast("double").alias("quality")
        )
        docs = docs.join(known, F.col("doc_id") == F.col("_id"), "left").drop("_id")
    again = Window.partitionBy("doc_id").orderBy("_text")
    u = (
        F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "doc_id")), 1, 13), 16, 10).cast(
            "long"
        )
        + 0.5
    ) / float(2**52)
    fit = F.when((F.col("quality") > 0) & ~F.isnan("quality"), F.col("quality")).otherwise(1.0)
    docs = durable(
        docs.select(
            "doc_id",
            F.row_number().over(again).alias("nth"),
            "source",
            "size",
            (-F.log(u) / fit).alias("key"),
        ),
        "mix-sizes",
    )
    sources = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = durable(budgets(sources, weights, most_epochs), "mix-budgets")
    placed = running_totals(docs, ["source"], ["key", "doc_id", "nth"], "size", "mix-ranges")
    goal = join_same(placed, goals, ["source"])
    epochs = F.when(
        F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))
    ).otherwise(F.lit(0))
    rest = F.col("target") - F.col("epochs") * F.col("source_size")
    return (
        goal.withColumn("epochs", epochs.cast("long"))
        .withColumn("copies", F.col("epochs") + (F.col("before") + F.col("size") / 2 <= rest).cast("long"))
        .select(
            "doc_id", "nth", "source", "size", "source_size", "target", "copies",
            (F.col("copies") * F.col("size")).alias("taken"),
        )
    )


def apply_mix(documents: DataFrame, mixed: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents as the mix has them: each as many times as it is taken.

    Documents of size 0 have no words to take and leave. The text is dealt once,
    by id, for the numbering and the join.
    """
    # The input's columns travel in a struct, so that none can clash.
    docs = documents.select(
        F.struct("*").alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark")
    ).withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy("mark")))
    mixed = mixed.where(F.col("taken") > 0).select(
        F.col("doc_id").alias("_id"), F.col("nth").alias("_nth"), F.col("copies")
    )
    # The difference keeps the second equality from becoming a join key, so that
    # the dealing by id serves both.
    met = docs.join(mixed, F.col("id").eqNullSafe(F.col("_id")) & (F.col("nth") - F.col("_nth") == 0))
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return met.select("row", each.alias("copy")).select("row.*")
