"""Exact duplicates by skew-safe combining.

1. Locally: every task reduces its rows to one per (salt, digest, text) before
   anything is shuffled; the salt is a hash of the row's id, so that a text which a
   third of all rows share is spread over ``SALTS`` groups.
2. Salted groups are merged: one winner (greatest id) and a count per salt.
3. Salt winners are combined globally, at most ``SALTS`` per text. A bit per salt
   remembers where the class has rows.

The text itself is a grouping key in all three stages: a digest only says where
texts meet. What goes back to the rows is a table of (salt, digest), so the hot
class's rows stay spread. A digest that stands for several texts is found by
counting, and its rows then meet their class by text.

DataFrame functions only. Texts are shuffled twice: the local winners, and one row
per salt and text.

Defined results: null text is empty; texts are equal if all their bytes are. Of a
class the row with the greatest id stays; rows without an id come last, and of rows
that are alike in id and text one stays. ``keep_id`` is null if no row of the class
has an id. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peerglass.llm.prefix import join_same
from peerglass.sources.tables import durable

SALTS = 64  # bits of a long


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _rows(documents: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    doc_id, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit(""))
    return documents.select(
        F.pmod(F.xxhash64(doc_id), F.lit(SALTS)).cast("int").alias("salt"),
        digest(text).alias("digest"),
        doc_id.alias("doc_id"),
        text.alias("text"),
    )


def _combined(rows: DataFrame) -> DataFrame:
    """(digest, text, keep_id, group_size, salts) per distinct text."""
    salted = rows.groupBy("salt", "digest", "text").agg(
        F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n")
    )
    return salted.groupBy("digest", "text").agg(
        F.max("keep_id").alias("keep_id"),
        F.sum("n").alias("group_size"),
        F.bit_or(F.expr("shiftleft(1L, salt)")).alias("salts"),
    )


def exact_duplicates(
    documents: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = sha256,
) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, digest) per row of ``documents``."""
    rows = _rows(documents, id_col, text_col, digest)
    names = ["digest", "keep_id", "group_size", "salts"]
    classes = durable(_combined(rows).select(*names), "exact-classes")
    shared = classes.groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1").select("digest")
    shared = durable(shared, "exact-shared")
    held = F.filter(
        F.sequence(F.lit(0), F.lit(SALTS - 1)),
        lambda s: F.col("salts").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), s)) != 0,
    )
    met = rows.drop("text")
    parts = []
    if shared.isEmpty():  # the digest stands for one text
        parts.append((met, classes, ["salt", "digest"]))
    else:
        parts.append((
            met.join(shared, "digest", "left_anti"), classes.join(shared, "digest", "left_anti"), ["salt", "digest"],
        ))
        mixed = rows.join(shared, "digest", "left_semi")
        parts.append((mixed, _combined(mixed), ["salt", "digest", "text"]))
    out = None
    for left, right, keys in parts:
        placed = left.join(right.withColumn("salt", F.explode(held)).drop("salts"), keys)
        alike = Window.partitionBy(*keys, "doc_id").orderBy(F.lit(0))
        placed = placed.select(
            "doc_id", "keep_id", "group_size",
            (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.row_number().over(alike) == 1)).alias("kept"),
            "digest",
        )
        out = placed if out is None else out.unionByName(placed)
    return out


def drop_copies(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, all columns as given.

    Rows alike in id and text are taken for one document and stay or go together.
    """
    found = exact_duplicates(documents, id_col=id_col, text_col=text_col)
    keep = found.where("kept").select("doc_id", "digest")
    marked = documents.select(
        F.struct("*").alias("row"),  # so that no column of the input can clash
        F.col(id_col).cast("long").alias("doc_id"),
        sha256(F.coalesce(F.col(text_col), F.lit(""))).alias("digest"),
    )
    return join_same(marked, keep, ["doc_id", "digest"], "left_semi").select("row.*")
