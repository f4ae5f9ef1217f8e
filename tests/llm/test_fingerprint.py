from __future__ import annotations

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from peerglass.llm.fingerprint import anchors, as_string, edited, fingerprint_with_next, likeness


def plain_anchors(text, k, s):
    """Positions whose least inner substring hash lies at an edge, one by one."""
    hashes = {}
    for n in (s,):
        for i in range(len(text) - n + 1):
            part = text[i : i + n]
            if part not in hashes:
                h = 0
                for c in part:
                    h = (h * 0x9E3779B97F4A7C15 + ord(c)) % 2**64
                for shift, by in ((31, 0xBF58476D1CE4E5B9), (29, 0x94D049BB133111EB)):
                    h = ((h ^ (h >> shift)) * by) % 2**64
                hashes[part] = h ^ (h >> 32)
    out = []
    for i in range(len(text) - k + 1):
        inner = [hashes[text[j : j + s]] for j in range(i, i + k - s + 1)]
        if min(inner) in (inner[0], inner[-1]):
            out.append(i)
    return out


def test_anchors_against_definition():
    rng = random.Random(1)
    for n in (0, 5, 20, 21, 400):
        text = "".join(rng.choice("abcdé ") for _ in range(n))
        for k, s in ((20, 6), (9, 4)):
            at, hashes = anchors(text, k, s)
            want = plain_anchors(text, k, s)
            assert list(at) == (want or ([0] if n else []))
            assert len(as_string(hashes)) == 8 * len(at)


def test_anchors_do_not_depend_on_context():
    rng = random.Random(2)
    text = "".join(rng.choice("abcdefgh ") for _ in range(600))
    inner = set(anchors(text[200:400])[1])
    assert inner <= set(anchors(text)[1]) and len(inner) > 10


def brute(rows):
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for (doc, text), (_, following) in zip(order, order[1:] + order[:1]):
        a, b, c = (np.unique(anchors(t)[1]) for t in (text, edited(text, following), following))
        changed = edited(text, following)
        out[doc] = (len(text), hashlib.sha256(changed.encode()).hexdigest(), likeness(a, b), likeness(a, c))
    return out


def test_next_documents_across_ranges(docs_of):
    rng = random.Random(3)
    rows = [(i * 5 % 1009, "".join(rng.choice("abc éß𝄞\n") for _ in range(rng.choice([0, 1, 2, 30, 300])))) for i in range(300)]
    rows[5] = (rows[5][0], "x" * 50_000)
    df = docs_of([(i, t or None) for i, t in rows]).withColumn("range", F.lit(0)).repartition(7)
    for blocks in (1, 5, 64):
        got = {r.doc_id: r for r in fingerprint_with_next(df, blocks=blocks).collect()}
        assert {i: (r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for i, r in got.items()} == brute(rows)
    for doc, text in rows:
        assert got[doc].fingerprint == as_string(anchors(text)[1])


def test_one_repeated_null_and_no_documents(docs_of):
    one = fingerprint_with_next(docs_of([(4, "abcdef")])).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and one.near_next == 1.0
    got = fingerprint_with_next(docs_of([(4, "same"), (4, "same"), (None, "other")])).collect()
    assert len(got) == 3 and len({r.fingerprint for r in got if r.doc_id == 4}) == 1
    assert fingerprint_with_next(docs_of([])).count() == 0
    assert fingerprint_with_next(docs_of([(1, None)])).first().near_edited == 1.0
