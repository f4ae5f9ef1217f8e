from __future__ import annotations

import random
from collections import Counter

import corpus_pipeline as P
from peerglass.llm.line_dedup import drop_recurring_lines
from test_minhash import brute
from test_packing import checked


def corpus():
    rng = random.Random(8)
    stock = {  # few enough words for a dictionary to know, too many for equal shingles
        letters: ["".join(rng.choice(letters) for _ in range(12)) for _ in range(300)]
        for letters in ("abcdefghijklm", "nopqrstuvwxyz")
    }
    word = lambda letters: rng.choice(stock[letters])
    rows = []
    for i in range(90):
        lang, letters = ("en", "abcdefghijklm") if i % 2 else ("de", "nopqrstuvwxyz")
        text = " ".join(word(letters) for _ in range(60))
        rows.append((i, f"{text}\n{word(letters)} {word(letters)}", lang, f"s{i % 5}"))
    rows += [(100 + i, rows[i][1], rows[i][2], "s1") for i in range(4)]
    rows += [(110, None, "en", "s1"), (111, "12 34", "en", "s1"), (112, "", None, None)]
    rows += [(120 + i, rows[i][1] + "\nall rights reserved", "en", None) for i in range(6)]
    return rows


def test_stages(spark, docs_of, tmp_path):
    rows = corpus()
    docs_of(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(
        f"{tmp_path}/labels.parquet"
    )
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in P.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, str(tmp_path)).cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
        if name == "language_id":
            assert set(kept[name]) == {r[0] for r in rows} - {110, 111, 112}
        elif name == "line_dedup":
            want = {r.doc_id: r.text for r in drop_recurring_lines(before).collect()}
            assert kept[name] == {i: t for i, t in want.items() if t.strip()}
            assert sum("all rights reserved" in t for t in kept[name].values()) == 1
        elif name == "minhash_near_dedup":
            given = [(r.doc_id, r.text) for r in before.collect()]
            assert set(kept[name]) == {r[0] for r in brute(given, 5, 80) if r[3]}
        else:
            copies = Counter(r.doc_id for r in docs.collect())
            assert max(copies.values()) <= 3
    packed = P.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    tokens = Counter()
    for p in packed:
        tokens[p.doc_id] += p.length
    assert set(tokens) == set(kept["mix_sources"])
    once = docs.dropDuplicates(["doc_id"])
    given = [(r.doc_id, r.text) for r in once.collect()]
    checked(given, P.STAGES[-1][1](spark, once, str(tmp_path)).collect(), 4096)
    assert len(P.run(spark, str(tmp_path)).collect()) == len(packed)


def test_empty(spark, docs_of, tmp_path):
    docs_of([]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_rows_that_share_an_id_or_have_none(spark, tmp_path):
    rng = random.Random(3)
    words = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(9)) for _ in range(40))
    a, b, c, d = (words() for _ in range(4))
    given = [(1, a), (1, b), (2, a), (None, c), (None, c), (None, c), (None, a), (3, d), (None, d), (3, d), (4, ""), (None, None)]
    docs = spark.createDataFrame(given, "doc_id long, text string").repartition(5)
    got = [tuple(r) for r in P.near_dedup(spark, docs, str(tmp_path)).collect()]
    assert Counter(got) == Counter([(1, a), (1, b), (None, c), (3, d), (4, ""), (None, None)])


CLASHING = ["row", "found", "_found", "gone", "_doc", "_mark", "_lines", "n_lines", "n_dropped", "_id", "_at", "_nth", "nth", "_copies", "copies", "copy", "_copy", "id", "mark", "group", "leaf"]


def test_columns_of_any_name_pass_every_stage(spark, docs_of, tmp_path):
    docs = docs_of(corpus()).selectExpr("*", *(f"concat('{c}', doc_id) AS {c}" for c in CLASHING))
    plain = docs_of(corpus())
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in P.STAGES[:-1]:
        docs, plain = stage(spark, docs, str(tmp_path)).cache(), stage(spark, plain, str(tmp_path)).cache()
        assert docs.columns == [*plain.columns, *CLASHING]
        rows = docs.collect()
        assert Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text) for r in plain.collect())
        assert all(r[c] == f"{c}{r.doc_id}" for r in rows for c in CLASHING)
    P.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
