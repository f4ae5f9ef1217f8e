from __future__ import annotations

import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from peerglass.llm.exact_dedup import drop_copies, exact_duplicates


def brute(rows):
    groups = defaultdict(list)
    for doc, text, *_ in rows:
        groups[text or ""].append(doc)
    out = []
    for text, ids in groups.items():
        ids.sort(key=lambda i: (i is not None, i or 0), reverse=True)
        for n, i in enumerate(ids):
            out.append((i, ids[0], len(ids), n == 0, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    rows = df.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest"))).collect()
    return sorted((tuple(r) for r in rows), key=repr)


ROWS = (
    [(i, "hot") for i in range(400)]
    + [(i + 1000, f"text {i % 90}") for i in range(250)]
    + [(2000, None), (2001, ""), (2002, " "), (None, "hot"), (None, "alone"), (None, "alone")]
    + [(7, "same id"), (7, "same id"), (7, "other"), (-5, "é"), (5, "é"), (8, "a\x00"), (9, "a")]
    + [(3000, "x" * 300_000), (3001, "x" * 300_000), (3002, "x" * 299_999 + "y")]
)


def test_equal_texts_and_their_winners(docs_of):
    assert found(exact_duplicates(docs_of(ROWS).repartition(5))) == brute(ROWS)


def test_equal_digests_of_unlike_texts_are_told_apart(docs_of):
    weak = lambda text: F.concat(F.length(text).cast("string"), F.substring(text, 1, 2)).cast("binary")
    got = exact_duplicates(docs_of(ROWS).repartition(5), digest=weak)
    rows = sorted((tuple(r)[:4] for r in got.collect()), key=repr)
    assert rows == sorted((r[:4] for r in brute(ROWS)), key=repr)


def test_empty_table_and_further_columns(docs_of):
    assert exact_duplicates(docs_of([])).count() == 0
    names = ("salt", "digest", "keep_id", "group_size", "kept", "n", "salts", "_digest", "row", "digest")
    docs = docs_of(ROWS).withColumns({c: F.lit(c) for c in names})
    assert found(exact_duplicates(docs)) == brute(ROWS)
    left = drop_copies(docs)
    assert left.columns == docs.columns
    kept = [r[:2] for r in brute(ROWS) if r[3]]
    assert sorted(map(repr, {r.doc_id for r in left.collect()})) == sorted(map(repr, {k[0] for k in kept}))


def test_no_python_on_the_main_path(docs_of):
    plan = exact_duplicates(docs_of(ROWS))._jdf.queryExecution().toString()
    assert "Python" not in plan and "ArrowEval" not in plan
