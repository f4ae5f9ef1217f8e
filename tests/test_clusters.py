"""Clustering of one study and of many windows."""

from __future__ import annotations

import random

import numpy as np
import pytest
from helpers import day
from pyspark.sql import functions as F

from peerglass.functions.shares import FEATURES
from peerglass.operators import clusters as CL
from peerglass.sources.tables import durable


@pytest.fixture(scope="module")
def inputs(spark):
    rng = random.Random(4)
    spots = {"x": (0.5, 5, 100, 0, 0, 0), "y": (1.0, 95, 5, 90, 0, 0), "z": (3.0, 40, 60, 60, 80, 1)}
    rows = []
    for w in ("w1", "w2"):
        for i in range(30):
            name = "xyz"[i % 3]
            g, u, c, s, a, h = spots[name]
            noise = lambda v: float(v) + rng.uniform(0, 2)
            rows.append((w, f"{name}{i:02d}", day(i % 5), noise(g) / 3, 0.0, noise(u), noise(c), noise(s), noise(a), float(h), "S"))
    df = spark.createDataFrame(
        rows,
        "window_id string, agent_id string, day date, demand_gwh double, log_demand double, pct_unregulated double, "
        "pct_contract double, pct_spot double, pct_auction double, has_auction double, segment string",
    )
    return CL.cluster_inputs(df)


def labels(df):
    return sorted((r["window_id"], r["agent_id"], r["day"], r["cluster_id"]) for r in df.collect())


def test_inputs_are_logged_then_clipped(inputs):
    r = inputs.orderBy("agent_id").first()
    import math

    assert r["x_pct_contract"] == pytest.approx(min(math.log1p(r["pct_contract"]), 300.0))
    assert r["x_log_demand"] == pytest.approx(math.log1p(r["demand_gwh"]))
    assert r["x_pct_unregulated"] == r["pct_unregulated"]


def test_grouped_kmeans_finds_the_groups(inputs):
    got = labels(CL.grouped_kmeans(inputs, k=3, starts=3))
    for w in ("w1", "w2"):
        by: dict = {}
        for win, agent, _, c in got:
            if win == w:
                by.setdefault(agent[0], set()).add(c)
        assert all(len(v) == 1 for v in by.values()) and len(set.union(*by.values())) == 3


def test_grouped_kmeans_does_not_depend_on_partitioning(inputs):
    a = labels(CL.grouped_kmeans(inputs.repartition(1), k=3, starts=3))
    b = labels(CL.grouped_kmeans(inputs.repartition(7), k=3, starts=3))
    assert a == b


def test_grouped_kmeans_with_fewer_points_than_centres(inputs):
    few = inputs.where("window_id = 'w1'").limit(2)
    assert {r[3] for r in labels(CL.grouped_kmeans(few, k=5, starts=2))} == {0, 1}


def plain_points(inputs, window):
    """Z-scores of one window."""
    rows = inputs.where(F.col("window_id") == window).select("agent_id", "day", *CL.CLUSTER_INPUTS).collect()
    x = np.array([[r[c] for c in CL.CLUSTER_INPUTS] for r in rows])
    s = x.std(axis=0)
    return [(r["agent_id"], r["day"]) for r in rows], np.where(s > 0, (x - x.mean(axis=0)) / np.where(s > 0, s, 1), 0)


def test_quality_against_plain_distances(inputs):
    table = CL.cluster_quality(inputs, [2, 3, 4], starts=2)
    got = {(r["window_id"], r["k"]): r for r in table.collect()}
    assert {k for (w, k), r in got.items() if r["is_best"]} == {3} and len(got) == 6
    of = {(w, a, d): c for w, a, d, c in labels(CL.grouped_kmeans(inputs, k=3, starts=2))}
    names, x = plain_points(inputs, "w1")
    label = np.array([of["w1", *n] for n in names])
    gaps = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    widths = []
    for i, c in enumerate(label):
        mean = {o: gaps[i, label == o].sum() / ((label == o).sum() - (o == c)) for o in set(label)}
        near = min(v for o, v in mean.items() if o != c)
        widths.append((near - mean[c]) / max(near, mean[c]))
    cost = sum(((x[label == c] - x[label == c].mean(axis=0)) ** 2).sum() for c in set(label))
    assert got["w1", 3]["silhouette"] == pytest.approx(np.mean(widths), abs=1e-3)
    assert got["w1", 3]["cost"] == pytest.approx(cost, abs=0.06)


def test_centres_rest_and_starts_do_not_hurt(inputs):
    points = durable(CL._standardised(inputs, ["window_id"]), "points")
    one, many = (CL.fitted_centers(points, ["window_id"], [4], n, 300).collect() for n in (1, 6))
    for a, b in zip(sorted(one), sorted(many)):
        assert b["cost"] <= a["cost"]


def test_tasks_and_steps_move_centres_alike(inputs):
    points = durable(CL._standardised(inputs, ["window_id"]), "points")
    run = lambda n: sorted(CL.fitted_centers(points, ["window_id"], [2, 5], 3, 300, in_task=n).collect())
    assert run(0) == run(10**6)


def test_steps_have_plans_of_one_size(inputs, monkeypatch):
    """A step reads the state that the one before wrote, and nothing older."""
    points = durable(CL._standardised(inputs, ["window_id"]), "points")
    sizes = []
    write = CL.durable

    def watched(df, label, *a, **k):
        if label == "centers":
            sizes.append(len(df._jdf.queryExecution().optimizedPlan().toString()))
        return write(df, label, *a, **k)

    first = write(CL._first_centers(points, ["window_id"], [5], 4), "first")
    monkeypatch.setattr(CL, "durable", watched)
    CL._moved_in_steps(points, first, ["window_id", "k", "start"], ["window_id"], 300)
    assert len(sizes) > 3 and max(sizes[1:]) < 1.05 * min(sizes[1:])


def test_best_number_is_used_where_none_is_given(inputs):
    got = labels(CL.grouped_kmeans(inputs, k=None, starts=1))
    assert {w: len({r[3] for r in got if r[0] == w}) for w in ("w1", "w2")} == {"w1": 3, "w2": 3}


def test_profiles(inputs):
    rows = inputs.withColumn("cluster_id", F.when(F.col("agent_id").startswith("x"), 0).otherwise(1))
    got = {(r["window_id"], r["cluster_id"]): r for r in CL.cluster_profiles(rows).collect()}
    x = got[("w1", 0)]
    assert x["n"] == 10 and x["n_agents"] == 10 and x["by_segment"] == {"S": 10}
    assert x["archetype"] == "Comercializador regulado"
    mean = rows.where("window_id = 'w1' and cluster_id = 0").agg(F.avg("pct_contract")).first()[0]
    assert x["pct_contract"] == pytest.approx(mean, abs=0.006)
    assert set(FEATURES) <= set(CL.cluster_profiles(rows).columns)


def test_only_distinct_points_are_moved(inputs):
    """Entities with equal days weigh as many points, but cost as one."""
    copies = inputs.withColumn("agent_id", F.explode(F.array(*(F.concat("agent_id", F.lit(f"-{i}")) for i in range(7)))))
    points = durable(CL._standardised(copies, ["window_id"]), "points")
    blocks = CL._blocks(points, ["window_id"])
    held = {r["window_id"]: r for r in blocks.groupBy("window_id").agg(
        F.sum(F.size("r")).alias("points"), F.sum(F.aggregate("r", F.lit(0).cast("long"), lambda a, x: a + x["n"])).alias("n")
    ).collect()}
    assert {w: (r["points"], r["n"]) for w, r in held.items()} == {"w1": (30, 210), "w2": (30, 210)}
    once = {(r["window_id"], r["k"]): r for r in CL.cluster_quality(inputs, [2, 3], starts=2).collect()}
    for r in CL.cluster_quality(copies, [2, 3], starts=2).collect():
        assert r["cost"] == pytest.approx(7 * once[r["window_id"], r["k"]]["cost"], abs=0.5)


def test_equally_far_points_go_by_their_entity_days(spark):
    """Of several distinct points at the greatest distance the last entity-day's is taken."""
    at = {"a": 0.0, "b": 2.0, "c": -2.0}
    rows = [("w", f"{n}{i}", day(0), [v] + [0.0] * 5) for n, v in at.items() for i in (0, 1)]
    points = spark.createDataFrame(rows, "window_id string, agent_id string, day date, point array<double>")
    (run,) = CL._first_centers(points, ["window_id"], [3], 1).collect()
    assert [c["center"][0] for c in run["centers"]] == [0.0, -2.0, 2.0]


def test_moves_within_a_task_look_at_each_point_once_and_then_at_changed_ones(monkeypatch):
    """Running sums give the centres of whole sums, also where a centre loses all its points."""
    import numpy as np

    from peerglass.operators import clusters as CL

    def whole_sums(x, n, centers, max_steps):
        for _ in range(max_steps):
            now = [{"id": i, "center": [s / 10**8 / c for s in sums]} for i, c, *sums, _ in CL._sums(x, n, centers)]
            if now == centers:
                break
            centers = now
        return centers

    monkeypatch.setattr(CL, "_CHUNK", 64)
    rng = np.random.default_rng(4)
    for case in range(12):
        x, n = np.round(rng.normal(size=(6, 500)), 8), rng.integers(1, 5, 500)
        places = [x[:, i].tolist() for i in range(4)] + [[9.0 * (case % 2)] * 6]
        first = [{"id": i, "center": p} for i, p in enumerate(places)]
        want = whole_sums(x, n, first, 300)
        monkeypatch.setattr(CL, "_sums", None)  # the rest of the steps must not sum all points again
        assert CL._rested(x, n, first, 300) == want
        monkeypatch.undo()
        monkeypatch.setattr(CL, "_CHUNK", 64)


def test_few_blocks_are_still_dealt_to_many_parts(spark, monkeypatch):
    monkeypatch.setattr(CL, "BLOCK", 50)
    points = spark.range(2000).select(
        F.lit("w").alias("window_id"), F.array(*[F.col("id").cast("double")] * len(CL.CLUSTER_INPUTS)).alias("point")
    )
    blocks = CL._blocks(points, ["window_id"])
    assert len(blocks.inputFiles()) >= spark.sparkContext.defaultParallelism
    assert blocks.agg(F.sum(F.size("r"))).first()[0] == 2000


def test_sums_are_exact_beyond_what_doubles_hold():
    size = len(CL.CLUSTER_INPUTS)
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(size, 500)), 8)
    centers = [{"id": i, "center": x[:, 9 * i].tolist()} for i in range(4)]
    near, gap = CL._nearest(x, [c["center"] for c in centers])
    for times in (1, 10**6 + 1):
        n = rng.integers(1, 9, 500) * times
        want = {}
        for i, j in enumerate(near.tolist()):
            cost = int(np.floor(gap[i] * 1e8 + 0.5))
            row = [int(n[i]), *(int(v) * int(n[i]) for v in np.rint(x[:, i] * 1e8)), cost * int(n[i])]
            want[j] = [a + b for a, b in zip(want.get(j, [0] * len(row)), row, strict=True)]
        assert {r[0]: list(r[1:]) for r in CL._sums(x, n, centers)} == want
