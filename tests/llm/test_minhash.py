from __future__ import annotations

import random
import re

import numpy as np

from peerglass.llm import components, minhash
from peerglass.llm.components import roots
from peerglass.llm.minhash import MinMax, near_duplicates


def word_sets(rows, k):
    out = []
    for _, text, *_ in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        out.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    return out


def brute(rows, k, threshold):
    sets, label = word_sets(rows, k), list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= threshold * (len(a) + len(sets[j]) - both):
                x, y = find(i), find(j)
                label[max(x, y)] = min(x, y)
    least = {}
    for i, (doc, *_) in enumerate(rows):
        r = find(i)
        least[r] = min(least.get(r, doc), doc)
    return sorted(
        (doc, len(sets[i]), least[find(i)], doc == least[find(i)]) for i, (doc, *_) in enumerate(rows)
    )


def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows = []
    for _ in range(12):
        base = [word() for _ in range(rng.choice([5, 40, 120]))]
        for _ in range(8):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                text[rng.randrange(len(text))] = word()
            rows.append(" ".join(text))
    chain = [word() for _ in range(100)]  # each like the next, the ends unlike
    for i in range(12):
        rows.append(" ".join(chain[3 * i : 3 * i + 60]))
    rows += ["", None, " \t\n", "One", "one ", "one two", "ONE\x0btwo", "É é", "é é", rows[0].upper()]
    rows += ["long " + " ".join(word() for _ in range(30_000))] * 2
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_against_brute_force(docs_of):
    rows = corpus()
    for words, threshold in ((3, 85), (5, 80)):
        got = sorted(map(tuple, near_duplicates(docs_of(rows), words=words, threshold=threshold).collect()))
        assert got == brute(rows, words, threshold)


def test_many_near_copies_that_are_not_alike_to_the_least(docs_of):
    rng = random.Random(1)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(60):
        text = list(base)
        for at in rng.sample(range(200), 4 + i % 3):
            text[at] = f"x{i}_{at}"
        rows.append((i, " ".join(text)))
    got = sorted(map(tuple, near_duplicates(docs_of(rows), words=3, threshold=80).collect()))
    assert got == brute(rows, 3, 80)


def test_repeats_nulls_and_empty(docs_of):
    rows = [(7, "a b c"), (7, "a b c"), (7, "d e f"), (3, "A B C")]
    got = sorted(map(tuple, near_duplicates(docs_of(rows)).collect()))
    assert got == [(3, 1, 3, True), (7, 1, 3, False), (7, 1, 3, False), (7, 1, 7, True)]
    nulls = docs_of([(1, None), (2, "")])
    assert sorted(map(tuple, near_duplicates(nulls).collect())) == [(1, 0, 1, True), (2, 0, 2, True)]
    assert near_duplicates(docs_of([])).count() == 0


def test_signature_is_unbiased():
    rng = np.random.default_rng(2)
    both, a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (600, 200, 200))
    h = MinMax(100, 4, 9)
    x, y = (h.signature(np.concatenate([both, z])) for z in (a, b))
    assert abs(np.mean(x == y) - 0.6) < 0.08


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 70)] + [(100, 101), (103, 101), (5, 5), (101, 100)]
    got = dict(roots(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 1 for i in range(2, 71)} | {101: 100, 103: 100}


def test_no_table_is_broadcast(docs_of, monkeypatch):
    plans = []

    def noted(df, *args, store=minhash.durable, **options):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return store(df, *args, **options)

    for module in (minhash, components):
        monkeypatch.setattr(module, "durable", noted)
    rows = corpus()
    found = near_duplicates(docs_of(rows), words=3, threshold=85)
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert sum("SortMergeJoin" in p for p in plans) > 5
    assert not [p for p in plans if "Broadcast" in p]
