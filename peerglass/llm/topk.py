"""Exact top-k search by inner product: tiles, partial selection, tree merging.

Queries are dealt into blocks and candidates into shards of bounded size. Every
(block, shard) tile is one matrix product, of which only the best k per query
leave the task; the lists of a query are then merged in a tree of bounded fan-in.
All queries meet all candidates, so nothing is missed.

Components become ``floor(scale * x)``. Products are exact: in doubles while sums
stay under 2**53, else in Python integers; scores beyond 64 bits are cut to the
ends of that range.

Defined results: rows whose id or vector is null, or whose vector is empty or
holds a null or non-finite component, take no part. Vectors of different lengths
do not meet. A query's own row is no candidate for it; another row with the same
id or the same vector is. Ties go to the smaller id. Rows repeated as queries
each get their list. Fewer candidates than k give all of them; no queries, or an
empty table, give an empty result. Further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peerglass.sources.tables import durable

PARTIAL = "query_row long, query_id long, shard int, vec_row long, vec_id long, score long"
_NONE = pa.table(
    {c: pa.array([], pa.int32() if c == "shard" else pa.int64())
     for c in ("query_row", "query_id", "shard", "vec_row", "vec_id", "score")}
)
_LOW, _HIGH = -(2**63), 2**63 - 1


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(row, vec_id, vec): rows that take part, with whole-number components as doubles."""
    x = F.col(vec_col).cast("array<double>")
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v * scale) < float("inf")))
    return (
        vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull())
        .where((F.size(vec_col) > 0) & sound)
        .select(
            F.monotonically_increasing_id().alias("row"),
            F.col(id_col).cast("long").alias("vec_id"),
            F.transform(x, lambda v: F.rint(v * scale - F.pmod(v * scale, F.lit(1.0)))).alias("vec"),
        )
    )


def _matrix(table: pa.Table, dim: int) -> np.ndarray:
    return pc.list_flatten(table.column("vec")).to_numpy().reshape(-1, dim)


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Column numbers of each row's best k: highest first, ties to the lower column."""
    n = scores.shape[1]
    if n > 2 * k:
        least = np.partition(scores, n - k, axis=1)[:, n - k]
        out = np.empty((len(scores), k), dtype=np.int64)
        for i, (row, low) in enumerate(zip(scores, least, strict=True)):
            above = np.flatnonzero(row > low)
            level = np.flatnonzero(row == low)[: k - len(above)]
            pick = np.concatenate([above, level])
            out[i] = pick[np.lexsort((pick, -row[pick]))]
        return out
    return np.argsort(-scores, axis=1, kind="stable")[:, :k]


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number matrices, as 64-bit integers."""
    bound = np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * q.shape[1]
    if bound < 2**53:
        return np.rint(q @ c.T).astype(np.int64)
    whole = lambda m: np.array([[int(v) for v in r] for r in m], dtype=object)
    exact = whole(q) @ whole(c).T
    return np.array([[min(max(v, _LOW), _HIGH) for v in r] for r in exact], dtype=np.int64)


def _tile(k: int):
    def run(key: tuple, tile: pa.Table) -> pa.Table:
        queries, shard = (tile.filter(pc.equal(tile["asks"], a)) for a in (True, False))
        if not queries.num_rows or not shard.num_rows:
            return _NONE
        dim = key[2].as_py()
        shard = shard.sort_by([("vec_id", "ascending"), ("row", "ascending")])
        q, c = _matrix(queries, dim), _matrix(shard, dim)
        q_row = queries.column("row").to_numpy()
        c_row = shard.column("row").to_numpy()
        scores = products(q, c)
        # One more than k, since a query's own row may be among them.
        cols = _best(scores, min(k + 1, c.shape[0]))
        at = np.repeat(np.arange(len(q)), cols.shape[1])
        col = cols.ravel()
        other = c_row[col] != q_row[at]
        at, col = at[other], col[other]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        at, col = at[place < k], col[place < k]
        return pa.table(
            {
                "query_row": q_row[at],
                "query_id": queries.column("vec_id").to_numpy()[at],
                "shard": np.full(len(at), key[1].as_py(), dtype=np.int32),
                "vec_row": c_row[col],
                "vec_id": shard.column("vec_id").to_numpy()[col],
                "score": scores[at, col],
            }
        )

    return run


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    *,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    scale: int = 256,
    block_rows: int = 2048,
    shard_rows: int = 4096,
    min_shards: int = 48,
    fan_in: int = 16,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best other rows.

    ``is_query`` is a condition on column ``vec_id``. A tile holds about
    ``block_rows`` x ``shard_rows`` products; at least ``min_shards`` shards keep
    a small table's work spread.
    """
    rows = durable(quantised(vectors, id_col, vec_col, scale), "topk-vectors")
    counts = rows.agg(F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("q")).first()
    shards = max(math.ceil(counts["n"] / shard_rows), min_shards)
    blocks = max(math.ceil(counts["q"] / block_rows), 1)
    place = F.xxhash64("row")
    kept = (F.size("vec").alias("dim"), "row", "vec_id", "vec")

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    queries = rows.where(is_query).select(
        F.pmod(place, F.lit(blocks)).cast("int").alias("block"),
        every(shards).alias("shard"), F.lit(True).alias("asks"), *kept,
    )
    candidates = rows.select(
        every(blocks).alias("block"),
        F.pmod(place, F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("asks"), *kept,
    )
    tiles = queries.unionByName(candidates).groupBy("block", "shard", "dim")
    lists = tiles.applyInArrow(_tile(k), PARTIAL)
    while True:
        lists = lists.withColumn("shard", F.floor(F.col("shard") / fan_in).cast("int"))
        order = Window.partitionBy("query_row", "query_id", "shard").orderBy(
            F.desc("score"), "vec_id", "vec_row"
        )
        lists = lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        shards = math.ceil(shards / fan_in)
        if shards == 1:
            return lists.select("query_id", "rank", "vec_id", "score")
