"""K-means over entity-days, its archetype profiles, and the choice of k."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import partial, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from peerglass.functions.naming import archetype_name
from peerglass.functions.numeric import dec_round
from peerglass.functions.shares import FEATURES
from peerglass.operators import WINDOW
from peerglass.sources.tables import durable

NUMBERS = range(2, 11)  # of clusters that are tried where none is given
CLUSTER_INPUTS = tuple(f"x_{f}" for f in FEATURES)


def cluster_inputs(
    panel: DataFrame,
    log_features: tuple[str, ...] = ("pct_contract", "pct_spot"),
    contract_clip: float | None = 300.0,
    transforms: dict | None = None,
) -> DataFrame:
    """Feature columns as clustering sees them: logs, then the clip.

    The clip comes after the log, as published, and so seldom binds.
    ``transforms`` replaces the log of a feature by another Column function.
    """
    functions = {f: F.log1p for f in log_features} | (transforms or {})
    out = {}
    for f in FEATURES:
        x = F.log1p("demand_gwh") if f == "log_demand" else F.col(f)
        if f in functions and f != "log_demand":
            x = functions[f](x)
        if f == "pct_contract" and contract_clip is not None:
            x = F.least(x, F.lit(float(contract_clip)))
        out[f"x_{f}"] = F.coalesce(x, F.lit(0.0))
    return panel.withColumns(out)


# --------------------------------------------------- many windows at once
def _standardised(inputs: DataFrame, keys: list[str]) -> DataFrame:
    """Z-scores per window to eight decimals; a constant feature becomes zero.

    Inputs are taken to eight decimals and summed as decimals, so that points depend
    neither on the row order nor on an engine's logarithm.
    """
    exact = {x: F.round(F.col(x).cast("decimal(30,12)"), 8).cast("decimal(18,8)") for x in CLUSTER_INPUTS}
    fixed = inputs.select(*keys, "agent_id", "day", *[v.alias(x) for x, v in exact.items()])
    aggs = [F.count(F.lit(1)).cast("double").alias("n")]
    for x in CLUSTER_INPUTS:
        aggs += [
            F.sum(x).cast("double").alias(f"m_{x}"),
            F.sum(F.col(x) * F.col(x)).cast("double").alias(f"s_{x}"),
        ]
    # Stored, so that its true size lets every point meet it without a shuffle.
    stats = durable(fixed.groupBy(*keys).agg(*aggs), "scale")

    def z(x: str) -> Column:
        mean = F.col(f"m_{x}") / F.col("n")
        spread = F.sqrt(F.greatest(F.col(f"s_{x}") / F.col("n") - mean * mean, F.lit(0.0)))
        value = (F.col(x).cast("double") - mean) / spread
        return F.when(spread > 1e-9, F.round(value.cast("decimal(30,12)"), 8).cast("double")).otherwise(0.0)

    return fixed.join(stats, keys).select(
        *keys, "agent_id", "day", F.array(*[z(x) for x in CLUSTER_INPUTS]).alias("point")
    )


def _gap(a: Column, b: Column, size: int) -> Column:
    """Squared distance of two points."""
    parts = [(a[i] - b[i]) * (a[i] - b[i]) for i in range(size)]
    return reduce(lambda x, y: x + y, parts)


def nearest_center(point: Column, centers: Column, size: int = len(CLUSTER_INPUTS)) -> Column:
    """``(gap, id)`` of the nearest centre; ties go to the lower id."""
    return F.array_min(
        F.transform(
            centers, lambda c: F.struct(_gap(point, c["center"], size).alias("gap"), c["id"].alias("id"))
        )
    )


def _blocks(points: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks (keys, block, r) of bounded size; equal points of a window are one, with their number.

    Only a window's distinct points are ever moved: ``r`` holds (point, n). Blocks
    given are returned as they are.
    """
    if "r" in points.columns:
        return points
    distinct = durable(points.groupBy(*keys, "point").agg(F.count(F.lit(1)).alias("n")), "distinct")
    counts = durable(
        distinct.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).alias("blocks")), "counts"
    )
    block = F.pmod(F.xxhash64("point"), F.col("blocks")).alias("block")
    # A fixed number of parts: few blocks are small, but every step works through all of them.
    parts = 2 * points.sparkSession.sparkContext.defaultParallelism
    return durable(
        distinct.join(counts, keys)
        .select(*keys, block, "point", "n")
        .repartition(parts, *keys, "block")
        .groupBy(*keys, "block")
        .agg(F.collect_list(F.struct("point", "n")).alias("r")),
        "blocks",
    )


def _gaps(x: np.ndarray, center: Sequence[float], out: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Squared distances to one centre in ``out``, the terms added in the order of ``_gap``."""
    np.subtract(x[0], center[0], out=out)
    np.multiply(out, out, out=out)
    for i in range(1, len(x)):
        np.subtract(x[i], center[i], out=step)
        np.multiply(step, step, out=step)
        np.add(out, step, out=out)
    return out


def _nearest(x: np.ndarray, centers: Sequence[Sequence[float]]) -> tuple[np.ndarray, np.ndarray]:
    """Place of the nearest centre of every point, the first of equals, and the distance."""
    gap, other, step = np.empty((3, x.shape[1]))
    _gaps(x, centers[0], gap, step)
    near = np.zeros(len(gap), dtype=np.intp)
    for c in range(1, len(centers)):
        _gaps(x, centers[c], other, step)
        np.putmask(near, other < gap, c)
        np.minimum(gap, other, out=gap)
    return near, gap


def _run_over_blocks(
    blocks: DataFrame, runs: DataFrame, keys: list[str], of_run: list[str], found: Callable, schema: str
) -> DataFrame:
    """Rows (keys, of_run, ...) that ``found(x, n)(centers)`` gives for every block and run of its window.

    ``x`` is a row per dimension, ``n`` how often each point occurs.
    """
    size, types = len(CLUSTER_INPUTS), dict(runs.dtypes)
    packed = runs.groupBy(*keys).agg(F.collect_list(F.struct(*of_run, "centers")).alias("runs"))
    flat = blocks.join(packed, keys).select(
        *keys, F.flatten(F.col("r.point")).alias("x"), F.col("r.n").alias("n"), "runs"
    )
    names = [*keys, *of_run, *(f.split()[0] for f in schema.split(", "))]

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in range(batch.num_rows):
                of = {c: batch.column(c)[row] for c in batch.schema.names}
                x = np.ascontiguousarray(of["x"].values.to_numpy().reshape(-1, size).T)
                n, key = of["n"].values.to_numpy(), [of[c].as_py() for c in keys]
                rows_of = found(x, n)
                for run in of["runs"].as_py():
                    out += [(*key, *(run[c] for c in of_run), *r) for r in rows_of(run["centers"])]
            if out:
                table = pa.Table.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names)
                yield from table.cast(wanted).to_batches()

    types = ", ".join(f"{c} {types[c]}" for c in [*keys, *of_run]) + ", " + schema
    wanted = to_arrow_schema(StructType.fromDDL(types))
    return flat.mapInArrow(over, types)


def _farthest(points: DataFrame, blocks: DataFrame, centers: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start, gap, p): the point farthest from a start's centres, of equals that of the last entity-day."""

    def found(x: np.ndarray, n: np.ndarray) -> Callable[[list[dict]], list[tuple]]:
        def rows(given: list[dict]) -> list[tuple]:
            gap = _nearest(x, [c["center"] for c in given])[1]
            return [(float(gap[i]), x[:, i].tolist()) for i in np.flatnonzero(gap == gap.max())]

        return rows

    rows = _run_over_blocks(blocks, centers, keys, ["start"], found, "gap double, p array<double>")
    top = F.rank().over(Window.partitionBy(*keys, "start").orderBy(F.desc("gap")))
    far = durable(rows.withColumn("place", top).where("place = 1").select(*keys, "start", "gap", "p"), "far")
    one = [*keys, "start"]
    if far.groupBy(*one).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return far
    # Equally far points: the entity-days themselves decide.
    named = points.join(F.broadcast(far.select(*keys, F.col("p").alias("point")).distinct()), [*keys, "point"])
    last = named.groupBy(*keys, "point").agg(F.max(F.struct("agent_id", "day")).alias("last"))
    return (
        far.join(last.withColumnRenamed("point", "p"), [*keys, "p"])
        .groupBy(*one)
        .agg(F.max("gap").alias("gap"), F.max_by("p", "last").alias("p"))
    )


def _first_centers(
    points: DataFrame, keys: list[str], ks: list[int], starts: int, blocks: DataFrame | None = None
) -> DataFrame:
    """Starting centres (keys, k, start, centers): one entity-day, then the farthest ones.

    Starts differ in their first entity-day: the least one, then others by a digest. A
    start's centres for k are the first k of one sequence. Each step is one pass over
    the distinct points.
    """
    blocks = _blocks(points, keys) if blocks is None else blocks
    name = "concat_ws('|', agent_id, cast(day as string), '{}')"
    firsts = [F.min_by("point", F.struct("agent_id", "day"))] + [
        F.min_by("point", F.struct(F.md5(F.expr(name.format(s))), "agent_id", "day"))
        for s in range(1, starts)
    ]
    centers = (
        points.groupBy(*keys)
        .agg(F.array(*firsts).alias("p"))
        .select(*keys, F.posexplode("p").alias("start", "p"))
        .select(*keys, "start", F.array(F.struct(F.lit(0).alias("id"), F.col("p").alias("center"))).alias("centers"))
    )
    centers = durable(centers, "centers")
    for i in range(1, max(ks)):
        far = _farthest(points, blocks, centers, keys)
        further = F.array(F.struct(F.lit(i).alias("id"), F.col("p").alias("center")))
        centers = durable(
            centers.join(far, [*keys, "start"], "left").select(
                *keys, "start",
                F.when(F.col("gap") > 0, F.concat("centers", further))
                .otherwise(F.col("centers"))
                .alias("centers"),
            ),
            "centers",
        )
    return centers.withColumn("k", F.explode(F.array(*(F.lit(k) for k in ks)))).select(
        *keys, "k", "start", F.slice("centers", 1, F.col("k")).alias("centers")
    )


def _assigned(points: DataFrame, centers: DataFrame, keys: list[str]) -> DataFrame:
    near = nearest_center(F.col("point"), F.col("centers"))
    return points.join(centers, keys).withColumn("near", near).select(
        *(c for c in points.columns), "k", "start", F.col("near.id").alias("id"), F.col("near.gap").alias("gap")
    )


_CENTERS = "array<struct<id:int,center:array<double>>>"
BLOCK = 16_384  # distinct points in a block
_CHUNK = 8_192  # points whose distances stay in a core's cache
IN_TASK = 200_000  # distinct points of a window up to which one task moves its centres until they rest


_HELD = 2.0**52  # whole numbers that add up to less are added exactly as doubles


def _added(near: np.ndarray, values: np.ndarray, size: int) -> list[int]:
    """Sums of whole numbers by place; exact."""
    if np.abs(values).sum(dtype=float) < _HELD:
        return np.bincount(near, values, size).astype(np.int64).tolist()
    out = np.zeros(size, dtype=np.int64)
    np.add.at(out, near, values)
    return out.tolist()


def _whole(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Points in 1e-8, as often as they occur."""
    return np.rint(x * 1e8).astype(np.int64) * n


def _sums(x: np.ndarray, n: np.ndarray, centers: list[dict], whole: np.ndarray | None = None) -> list[tuple]:
    """(id, n, sums in 1e-8, cost in 1e-8) of every centre that is nearest to some point; sums are exact."""
    whole = _whole(x, n) if whole is None else whole
    near, gap = _nearest(x, [c["center"] for c in centers])
    cost = np.floor(gap * 1e8 + 0.5).astype(np.int64) * n
    there = np.bincount(near, minlength=len(centers))
    added = zip(*(_added(near, v, len(centers)) for v in (n, *whole, cost)), strict=True)
    return [(c["id"], *row) for c, row, some in zip(centers, added, there, strict=True) if some]


def _summed(blocks: DataFrame, runs: DataFrame, by: list[str], keys: list[str]) -> DataFrame:
    """Partial sums of ``_sums``, a row for every block, run and centre."""
    sums = ", ".join(f"s{i} long" for i in range(len(CLUSTER_INPUTS)))

    def found(x: np.ndarray, n: np.ndarray) -> Callable[[list[dict]], list[tuple]]:
        return partial(_sums, x, n, whole=_whole(x, n))

    return _run_over_blocks(
        blocks, runs, keys, [c for c in by if c not in keys], found, f"id int, n long, {sums}, cost long"
    )


def _exact(name: str) -> Column:
    """A sum of whole numbers of 1e-8, as a double rounded once."""
    return F.expr(f"cast(sum(cast({name} as decimal(18,0))) * 0.00000001BD as double)")


def _moved_in_steps(points: DataFrame, first: DataFrame, by: list[str], keys: list[str], max_steps: int) -> DataFrame:
    """Centres (by, centers) at rest, for windows of any size.

    All runs are one small table, written anew in every step from the one before, so a
    step's plan does not grow. Runs that rest are carried over, and their points are
    not looked at again. Only partial sums are shuffled.
    """
    blocks = _blocks(points, keys)
    size = len(CLUSTER_INPUTS)
    state = durable(first.select(*by, "centers", F.lit(False).alias("rests")), "centers")
    for _ in range(max_steps):
        moving = state.where("NOT rests")
        if moving.isEmpty():
            break
        # Whole sums make the centres independent of the row order.
        moved = (
            _summed(blocks, moving, by, keys)
            .groupBy(*by, "id")
            .agg(*[(_exact(f"s{i}") / F.sum("n")).alias(f"c{i}") for i in range(size)])
            .groupBy(*by)
            .agg(
                F.sort_array(
                    F.collect_list(
                        F.struct("id", F.array(*[F.col(f"c{i}") for i in range(size)]).alias("center"))
                    )
                ).alias("now")
            )
        )
        state = durable(
            state.join(moved, by, "left").select(
                *by, F.coalesce("now", "centers").alias("centers"),
                (F.col("rests") | F.coalesce(F.col("now") == F.col("centers"), F.lit(True))).alias("rests"),
            ),
            "centers",
        )
    return state.drop("rests")


def _rested(x: np.ndarray, n: np.ndarray, centers: list[dict], max_steps: int) -> list[dict]:
    """The same steps on the points of one window.

    Sums are whole numbers, so from the second step on only points that have changed
    their centre are added to one and taken from the other.
    """
    ids = max(c["id"] for c in centers) + 1
    whole = np.vstack([np.rint(x * 1e8).astype(np.int64) * n, n])
    parts = [(x[:, i : i + _CHUNK], slice(i, i + _CHUNK)) for i in range(0, x.shape[1], _CHUNK)]
    sums, label = np.zeros((ids, len(whole)), dtype=np.int64), None
    for _ in range(max_steps):
        name = np.array([c["id"] for c in centers])
        places = [c["center"] for c in centers]
        found = np.empty(x.shape[1], dtype=np.int64)
        for part, at in parts:
            found[at] = name[_nearest(part, places)[0]]
        moved = np.arange(len(found)) if label is None else np.flatnonzero(found != label)
        rows = whole[:, moved]
        for i in range(ids):
            sums[i] += rows[:, found[moved] == i].sum(axis=1)
            if label is not None:
                sums[i] -= rows[:, label[moved] == i].sum(axis=1)
        label = found
        now = [
            {"id": i, "center": [int(s) / 10**8 / int(sums[i, -1]) for s in sums[i, :-1]]}
            for i in range(ids)
            if sums[i, -1]
        ]
        if now == centers:
            break
        centers = now
    return centers


def _moved_in_tasks(
    blocks: DataFrame, first: DataFrame, by: list[str], keys: list[str], numbers: list[int], max_steps: int
) -> DataFrame:
    """Centres (by, centers) at rest, a group for each window and k; windows of bounded size only."""
    group, size = [*keys, "k"], len(CLUSTER_INPUTS)
    ks = first.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("start", "centers"))).alias("runs"))
    left = blocks.select(
        *keys, F.flatten(F.col("r.point")).alias("x"), F.col("r.n").alias("n"),
        F.explode(F.array(*(F.lit(k) for k in numbers))).alias("k"),
    )

    def fit(key: tuple, rows: pd.DataFrame, runs: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(runs):
            x = np.ascontiguousarray(np.concatenate(list(rows["x"])).reshape(-1, size).T)
            n = np.concatenate(list(rows["n"]))
            for run in runs["runs"].iloc[0]:
                centers = [{"id": int(c["id"]), "center": list(map(float, c["center"]))} for c in run["centers"]]
                out.append((*key, int(run["start"]), _rested(x, n, centers, max_steps)))
        return pd.DataFrame(out, columns=[*by, "centers"])

    types = dict(first.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in by) + f", centers {_CENTERS}"
    return left.groupBy(*group).cogroup(ks.groupBy(*group)).applyInPandas(fit, schema)


def fitted_centers(
    points: DataFrame,
    keys: list[str],
    ks: list[int],
    starts: int,
    max_steps: int,
    in_task: int | None = None,
    blocks: DataFrame | None = None,
) -> DataFrame:
    """(keys, k, centers, cost): the best of several starts, each moved until it rests.

    All windows, numbers of clusters and starts move in the same job. Windows of at
    most ``in_task`` distinct points are moved within tasks; larger ones step by step
    over all tasks. Both give the same centres.
    """
    limit = IN_TASK if in_task is None else in_task
    by = [*keys, "k", "start"]
    blocks = _blocks(points, keys) if blocks is None else blocks
    first = durable(_first_centers(points, keys, ks, starts, blocks), "centers")
    sizes = durable(
        blocks.groupBy(*keys).agg(F.sum(F.size("r")).alias("n")).select(*keys, (F.col("n") > limit).alias("large")),
        "sizes",
    )
    fitted = None
    for large in (False, True):
        some = sizes.where("large" if large else "NOT large").select(*keys)
        if some.isEmpty():
            continue
        mine, begin = blocks.join(some, keys, "left_semi"), first.join(some, keys, "left_semi")
        part = (
            _moved_in_steps(mine, begin, by, keys, max_steps)
            if large
            else durable(_moved_in_tasks(mine, begin, by, keys, ks, max_steps), "centers")
        )
        fitted = part if fitted is None else fitted.unionByName(part)
    if fitted is None:
        fitted = first
    cost = _summed(blocks, fitted, by, keys).groupBy(*by).agg(_exact("cost").alias("cost"))
    best = F.min_by(F.struct("centers", "cost"), F.struct("cost", "start")).alias("best")
    return durable(
        fitted.join(cost, by).groupBy(*keys, "k").agg(best).select(
            *keys, "k", F.lit(0).alias("start"), F.col("best.centers").alias("centers"), F.col("best.cost").alias("cost")
        ),
        "centers",
    )


def grouped_kmeans(
    inputs: DataFrame,
    k: int | None = 5,
    starts: int = 10,
    max_steps: int = 300,
    keys: list[str] = WINDOW,
) -> DataFrame:
    """K-means of every window in the same job: (keys, agent_id, day, cluster_id).

    Without k every window gets the number of clusters of best quality.
    """
    points = durable(_standardised(inputs, keys), "points")
    blocks = _blocks(points, keys)
    centers = fitted_centers(points, keys, [k] if k else list(NUMBERS), starts, max_steps, blocks=blocks)
    if not k:
        best = _quality(blocks, centers, keys).where("is_best").select(*keys, "k")
        centers = centers.join(best, [*keys, "k"], "left_semi")
    centers = centers.drop("cost")
    return _assigned(points, centers, keys).select(
        *keys, "agent_id", "day", F.col("id").alias("cluster_id")
    )


def cluster_quality(
    inputs: DataFrame,
    ks: Sequence[int] = NUMBERS,
    starts: int = 10,
    max_steps: int = 300,
    keys: list[str] = WINDOW,
) -> DataFrame:
    """(keys, k, cost, silhouette, is_best) over all entity-days of every window.

    The silhouette uses squared distances, whose mean to a cluster follows from the
    cluster's size, sum and sum of squares; so it is linear in the points. The best
    k has the greatest silhouette, ties going to fewer clusters; a k that is not
    under the number of points is left out.
    """
    points = durable(_standardised(inputs, keys), "points")
    blocks = _blocks(points, keys)
    return _quality(blocks, fitted_centers(points, keys, list(ks), starts, max_steps, blocks=blocks), keys)


def _quality(blocks: DataFrame, centers: DataFrame, keys: list[str]) -> DataFrame:
    points = blocks.select(*keys, F.inline("r")).withColumnRenamed("n", "times")
    enough = points.groupBy(*keys).agg(F.sum("times").alias("n_points"))
    times = F.col("times").cast("decimal(12,0)")
    # Stored, like the clusters' sums, so that their true size lets points meet them without a shuffle.
    centers = durable(centers.join(enough, keys).where("k < n_points"), "centers")
    size = len(CLUSTER_INPUTS)
    x = F.col("point")
    square = reduce(lambda a, b: a + b, [x[i] * x[i] for i in range(size)])
    assigned = _assigned(points, centers.drop("cost", "n_points"), keys).withColumn("square", square)
    held = (
        assigned.groupBy(*keys, "k", "id")
        .agg(
            F.sum("times").alias("n"),
            F.sum(F.col("square").cast("decimal(24,8)") * times).cast("double").alias("square"),
            *[F.sum(x[i].cast("decimal(20,8)") * times).cast("double").alias(f"s{i}") for i in range(size)],
        )
        .groupBy(*keys, "k")
        .agg(
            F.collect_list(
                F.struct("id", "n", "square", F.array(*[F.col(f"s{i}") for i in range(size)]).alias("sum"))
            ).alias("clusters")
        )
    )

    held = durable(held, "clusters")

    def gap(c: Column) -> Column:
        """Sum of squared distances from the point to a cluster's points."""
        cross = reduce(lambda a, b: a + b, [x[i] * c["sum"][i] for i in range(size)])
        return F.greatest(c["n"] * F.col("square") + c["square"] - 2 * cross, F.lit(0.0))

    own = F.filter("clusters", lambda c: c["id"] == F.col("id"))[0]
    other = F.array_min(
        F.transform(F.filter("clusters", lambda c: c["id"] != F.col("id")), lambda c: gap(c) / c["n"])
    )
    scored = assigned.join(held, [*keys, "k"]).select(
        *keys, "k", "times", own["n"].alias("n"), F.try_divide(gap(own), own["n"] - 1).alias("a"), other.alias("b")
    )
    width = F.when(F.col("n") == 1, 0.0).otherwise(
        F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))
    )
    scores = scored.groupBy(*keys, "k").agg(
        (F.sum(width.cast("decimal(20,10)") * times).cast("double") / F.sum("times")).alias("silhouette")
    )
    table = centers.join(scores, [*keys, "k"]).select(
        *keys, "k", dec_round(F.col("cost"), 1).alias("cost"), dec_round(F.col("silhouette"), 4).alias("silhouette")
    )
    best = table.groupBy(*keys).agg(F.max_by("k", F.struct("silhouette", -F.col("k"))).alias("best_k"))
    return table.join(best, keys).select(
        *keys, "k", "cost", "silhouette", (F.col("k") == F.col("best_k")).alias("is_best")
    )


# ------------------------------------------------------------- profiles
def cluster_profiles(panel: DataFrame, keys: list[str] = WINDOW) -> DataFrame:
    """Mean features, size, entities and segment make-up of every cluster, named.

    Entities are first counted per (cluster, segment, entity), so the distinct
    count does not gather a cluster in one task.
    """
    by_entity = panel.groupBy(*keys, "cluster_id", F.coalesce("segment", F.lit("?")).alias("segment"), "agent_id").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(F.col(f).cast("decimal(18,4)")).alias(f) for f in FEATURES],
    )
    by_segment = by_entity.groupBy(*keys, "cluster_id", "segment").agg(
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("n_agents"),
        *[F.sum(f).alias(f) for f in FEATURES],
    )
    out = by_segment.groupBy(*keys, "cluster_id").agg(
        F.sum("n").alias("n"),
        F.sum("n_agents").alias("n_agents"),
        *[dec_round(F.sum(f).cast("double") / F.sum("n"), 2).alias(f) for f in FEATURES],
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("segment", "n")))).alias("by_segment"),
    )
    return out.withColumn(
        "archetype",
        archetype_name(
            F.col("pct_unregulated"), F.col("pct_contract"), F.col("pct_spot"), F.col("pct_auction")
        ),
    )


def attach_archetypes(panel: DataFrame, profiles: DataFrame, keys: list[str] = WINDOW) -> DataFrame:
    """Archetype of each entity-day by its cluster; several clusters may share a name."""
    return panel.join(profiles.select(*keys, "cluster_id", "archetype"), keys + ["cluster_id"])
