from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from peerglass.llm import spelling
from peerglass.llm.queries import QUERIES


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts, ratio=10):
    near = {w: [] for w in counts}
    for a in counts:
        for b in counts:
            if one_edit(a, b):
                near[a].append(b)
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * n else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(out)


def noisy_words(seed, n, alphabet, lengths):
    rng = random.Random(seed)
    words = {"".join(rng.choice(alphabet) for _ in range(rng.choice(lengths))) for _ in range(n)}
    for w in list(words):
        for _ in range(rng.choice((0, 1, 3))):
            i, kind = rng.randrange(len(w)), rng.randrange(3)
            words.add(w[:i] + (rng.choice(alphabet) if kind else "") + w[i + (kind < 2) :])
    words.discard("")
    return {w: rng.choice((2, 3, 30, 400, 5000)) for w in words}


def table(spark, counts):
    return spark.createDataFrame(list(counts.items()), "word string, n long")


@pytest.mark.parametrize(
    "counts",
    [
        noisy_words(1, 300, "abcé", (7, 8, 9)),
        noisy_words(2, 200, "ab", (1, 2, 3, 5, 12)),
        noisy_words(3, 60, "xyzäö\U0001f600", (20, 30, 45)),
        {"a" * k: 10**k for k in range(1, 15)},
    ],
    ids=["dense", "short", "long", "chain"],
)
def test_near_words_forms_and_roots(spark, counts):
    got = sorted(tuple(r) for r in spelling.group_variants(table(spark, counts).repartition(3)).collect())
    assert got == brute(counts)


def test_hot_group_in_several_tiles(spark, monkeypatch):
    monkeypatch.setattr(spelling, "TILE", 40)  # read on the driver: the group falls into tiles
    rng = random.Random(4)
    counts = {"prefix" + a + b + "suffix": rng.choice((2, 50)) for a in "abcdefghijklmno" for b in "abcdefghijklm"}
    got = sorted(tuple(r) for r in spelling.group_variants(table(spark, counts)).collect())
    assert got == brute(counts)


def test_nulls_repeats_long_words_and_empty_tables(spark):
    rows = [("seventy", 5), ("seventy", 6), ("sevnty", 1), (None, 9), ("", 4), ("q" * 50_000, 3), ("q" * 50_001, 30)]
    got = {r.word: r for r in spelling.group_variants(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert set(got) == {"seventy", "sevnty", "q" * 50_000, "q" * 50_001}
    assert got["seventy"].n == 11 and got["sevnty"].form == "seventy" and got["q" * 50_000].root == "q" * 50_001
    assert spelling.group_variants(table(spark, {"a": 1}).where("n > 1")).count() == 0


def expected_counts(rows):
    found = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = re.sub("[A-Z]", lambda x: x[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{low}".encode())
            if h % 31 == 0:
                i = h % len(low)
                low = low[:i] + low[i + 1 :]
            if len(low) >= 7:
                found[low] += 1
    return {w: n for w, n in found.items() if n >= 2}


def test_query_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts = expected_counts([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.word: r.n for r in spelling.counted_words(docs).collect()} == counts
    df = QUERIES["op11_spelling_variants"](spark, sf_dir)
    assert df.dtypes[:6] == [
        ("word", "string"), ("form", "string"), ("root", "string"), ("n", "bigint"), ("n_near", "bigint"), ("form_n", "bigint"),
    ]
    assert sorted(tuple(r) for r in df.collect()) == brute(counts)


def test_documents_with_nulls_and_clashing_columns(spark):
    rows = [(1, "Straße Élanvital ÉLANVITAL", "a"), (None, "élanvital élanvital", "b"), (3, None, "c"), (4, "", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string")
    got = {r.word: r.n for r in spelling.counted_words(docs).collect()}
    assert got == expected_counts([r[:2] for r in rows])
