from __future__ import annotations

import math
from collections import Counter
from dataclasses import replace

import numpy as np

from peerglass.llm import pseudo_likelihood as P
from peerglass.llm.pseudo_likelihood import (
    Network,
    Settings,
    alphabet_of,
    score,
    score_documents,
    train,
    window_counts,
)

SMALL = Settings(alphabet=24, embedding=6, hidden=12, shards=3, rounds=2, steps=40, batch=256)


def windows_of(text, table):
    low = [table[ord(c)] for c in text.lower()]
    padded = [0, 0, *low, 0, 0]
    out = []
    for i in range(len(low)):
        w = 0
        for s in padded[i : i + 5]:
            w = (w << 7) | int(s)
        out.append(w)
    return out


def test_counts_cover_every_character(docs_of):
    rows = [(1, "Abca\x00é"), (2, None), (3, ""), (4, "abca")] + [(5 + i, "zz top") for i in range(20)]
    df = docs_of(rows).repartition(3)
    table = alphabet_of(df, 8)
    want = Counter(w for _, t in rows for w in windows_of(t or "", table))
    assert {r.window: r.n for r in window_counts(df, table).collect()} == want


def test_scores_are_sums_of_conditional_log_probabilities(docs_of):
    rows = [(i, "the cat sat on the mat " * (1 + i % 4)) for i in range(12)] + [(50, "xq" * 30), (51, None), (52, "t" * 40_000)]
    df = docs_of(rows)
    table = alphabet_of(df, SMALL.alphabet)
    net = train(window_counts(df, table), SMALL)
    got = {r.doc_id: r for r in score(df, table, net).collect()}
    for i, t in rows:
        w = np.array(windows_of(t or "", table), dtype=np.int64)
        total = net.log_p(w).sum()
        assert got[i].n_tokens == len(w) and math.isclose(got[i].log_likelihood, total, abs_tol=0.01)
    assert got[51].score is None
    w = np.array(windows_of("cat", table), dtype=np.int64)
    probabilities = np.exp(net._forward(w)[-1]).sum(axis=1)
    assert np.allclose(probabilities, 1)


def test_training_separates_text_from_noise(docs_of):
    rows = [(i, "and the rain in the plain") for i in range(30)] + [(99, "qzxvk pwjq xzkvq jqwpz")]
    got = {r.doc_id: r.score for r in score_documents(docs_of(rows), SMALL).collect()}
    assert got[0] > got[99] + 0.5


def test_gradients():
    net = Network.fresh(SMALL)
    rng = np.random.default_rng(0)
    w = np.zeros(30, dtype=np.int64)
    for _ in range(5):
        w = (w << 7) | rng.integers(0, SMALL.alphabet, 30)
    loss = lambda: -net.log_p(w).mean()
    for k, g in net.gradients(w).items():
        at = tuple(rng.integers(0, n) for n in g.shape)
        old = net.weights[k][at]
        net.weights[k][at] = old + 1e-5
        up = loss()
        net.weights[k][at] = old - 1e-5
        down = loss()
        net.weights[k][at] = old
        assert abs((up - down) / 2e-5 - g[at]) < 1e-6


def test_empty(docs_of):
    assert score_documents(docs_of([]), SMALL).count() == 0
    assert score_documents(docs_of([(1, None)]), SMALL).first().score is None


def test_training_passes_over_all_windows_in_bounded_shards(spark, monkeypatch):
    rng = np.random.default_rng(3)
    windows = np.unique(rng.integers(0, 24, (5000, 5)) @ (1 << 7 * np.arange(5)))
    counts = rng.integers(1, 9, len(windows))
    seen = []
    monkeypatch.setattr(Network, "gradients", lambda self, w, weight: seen.append((w, weight)) or {})
    assert Network.fresh(SMALL).train(windows, counts, replace(SMALL, steps=1), [1]) == len(windows)
    total = dict.fromkeys(windows.tolist(), 0.0)
    for w, weight in seen:
        assert len(w) <= SMALL.batch
        for x, y in zip(w.tolist(), weight, strict=True):
            total[x] += y
    assert np.allclose([total[x] for x in windows.tolist()], counts * len(seen) / counts.sum())


def test_shards_follow_the_table(spark, monkeypatch):
    df = spark.range(900).selectExpr("id % 30 + 128 * (id div 30) AS window", "1L AS n")
    made, plain = [], P._one_round
    monkeypatch.setattr(P, "_one_round", lambda net, r, s: made.append(r) or plain(net, r, s))
    sizes = []
    real = Network.unpacked
    monkeypatch.setattr(Network, "unpacked", lambda self, data: sizes.append(1) or real(self, data))
    train(df, replace(SMALL, rounds=1, steps=1, shard_windows=100))
    assert made == [0] and len(sizes) == 9


def test_rare_characters_differ(docs_of):
    common = "abcdefghijklmnopqrstuv" * 50
    table = alphabet_of(docs_of([(1, common), (2, "".join(map(chr, range(0x4E00, 0x4E40))))]), 24)
    rare = Counter(table[0x4E00:0x4E40].tolist())
    assert len(rare) > 16 and min(rare) >= 24
