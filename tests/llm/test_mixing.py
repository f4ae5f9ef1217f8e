from __future__ import annotations

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from peerglass.llm.mixing import apply_mix, mix
from peerglass.llm.prefix import running_totals


def level(sizes, weights, most):
    """Targets by sharing again and again what capped sources leave."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, rest, free = {}, float(sum(sizes.values())), set(names)
    while free:
        total = sum(w[s] for s in free)
        over = {s for s in free if rest * w[s] / total >= most * sizes[s]}
        if not over:
            return out | {s: rest * w[s] / total for s in free}
        for s in over:
            out[s] = float(most * sizes[s])
        rest -= sum(most * sizes[s] for s in over)
        free -= over
    return out


def corpus():
    rng = random.Random(4)
    rows = [(i, "w " * rng.randrange(40), "en", rng.choice(["b", "a", "a", "a", "é", None])) for i in range(600)]
    return rows + [(900, "x y", "en", "tiny"), (901, None, "en", "none"), (902, "", "en", "none")]


def test_targets_and_takes(docs_of):
    rows = corpus()
    got = mix(docs_of(rows)).collect()
    sizes = Counter()
    for _, text, _, source in rows:
        sizes[source] += len((text or "").split())
    goal = level(sizes, (1, 2, 3), 3)
    taken, largest = Counter(), defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - goal[r.source]) < 1e-6
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s, t in goal.items():
        assert abs(taken[s] - t) <= largest[s] / 2 + 1e-9, s
    for s in sizes:  # complete epochs before a fraction
        copies = {r.copies for r in got if r.source == s and r.size}
        assert not copies or max(copies) - min(copies) <= 1
    assert sorted(map(tuple, got)) == sorted(map(tuple, mix(docs_of(rows).repartition(7)).collect()))


def test_quality_raises_the_odds(docs_of, spark):
    rows = [(i, "a b c", "en", "big" if i < 400 else "small") for i in range(900)]
    quality = spark.createDataFrame([(i, 4.0 if i % 2 else 0.25) for i in range(900)], "doc_id long, quality double")
    got = mix(docs_of(rows), weights=(1, 8), quality=quality).where("source = 'big'").collect()
    good = sum(r.copies for r in got if r.doc_id % 2)
    bad = sum(r.copies for r in got if r.doc_id % 2 == 0)
    assert good > 1.5 * bad


def test_apply(docs_of):
    df = docs_of(corpus()).withColumn("copies", F.lit("clash"))
    mixed = mix(df)
    want = Counter({r.doc_id: r.copies for r in mixed.collect() if r.taken})
    out = apply_mix(df, mixed)
    assert out.columns == df.columns
    assert Counter(r.doc_id for r in out.collect()) == want


def test_repeats_and_empty(docs_of):
    rows = [(1, "a b", "en", "s"), (1, "a b", "en", "s"), (1, "c", "en", "s"), (None, "d", "en", None)]
    got = mix(docs_of(rows))
    assert sum(r.size for r in got.collect()) == 6 and got.count() == 4
    assert apply_mix(docs_of(rows), got).count() == sum(r.copies for r in got.collect())
    assert mix(docs_of([])).count() == 0
    blank = mix(docs_of([(1, "", "en", "s")])).first()
    assert (blank.target, blank.taken) == (0.0, 0)


def test_running_totals(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "a", None]), i, rng.randrange(9)) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, o long, v long").repartition(6)
    got = {r.o: r.before for r in running_totals(df, ["k"], ["o"], "v", "t").collect()}
    sums = Counter()
    for k, o, v in rows:
        assert got[o] == sums[k]
        sums[k] += v
