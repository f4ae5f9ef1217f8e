from __future__ import annotations

from pyspark.sql import functions as F

from peerglass.llm.line_dedup import body_of, drop_recurring_lines


def run(df, **k):
    return {r.doc_id: r for r in drop_recurring_lines(df, **k).collect()}


def test_templates_recur_across_documents(docs_of):
    rows = [(i, f"own line {'abcdefgh'[i]} here\nPosted on {i}.1.2020 by user {n} today\nend {'abcdefgh'[i]}")
            for i, n in enumerate(["ann", "bob", "cy", "di", "ed", "flo"])]
    got = run(docs_of(rows), min_docs=5)
    assert got[0].text == rows[0][1]
    for i in range(1, 6):
        assert got[i].text == f"own line {'abcdefgh'[i]} here\nend {'abcdefgh'[i]}"
        assert (got[i].n_lines, got[i].n_dropped) == (3, 1)
    assert run(docs_of(rows), min_docs=5, keep_first=False)[0].n_dropped == 1
    assert all(r.n_dropped == 0 for r in run(docs_of(rows), min_docs=7).values())


def test_prose_with_equal_beginnings_stays(docs_of):
    rows = [(i, "in the beginning " + " ".join(f"w{chr(97 + i)}{chr(97 + j)}" for j in range(9))) for i in range(9)]
    assert all(r.n_dropped == 0 for r in run(docs_of(rows), min_docs=3).values())


def test_repeats_within_one_document_do_not_recur(docs_of):
    rows = [(1, "same line\n" * 9), (2, "same line"), (3, "other")]
    assert all(r.n_dropped == 0 for r in run(docs_of(rows), min_docs=3).values())
    got = run(docs_of(rows), min_docs=2)
    assert got[1].text == "same line\n" and got[1].n_dropped == 8
    assert got[2].text == "" and got[3].text == "other"


def test_edge_cases(docs_of):
    long = "\n".join(f"l{chr(97 + i % 26)} x{chr(97 + i // 26 % 26)} y{chr(97 + i // 676 % 26)}" for i in range(15_000))
    rows = [(i, "x y\n\n \t\nx  y \n") for i in range(3)] + [(3, None), (4, ""), (5, long), (6, long), (None, "x y")]
    got = run(docs_of(rows), min_docs=2)
    # The least document is the one without an id.
    assert got[None].text == "x y"
    assert all(got[i].text == "\n \t\n" and got[i].n_dropped == 2 for i in range(3))
    assert (got[3].text, got[3].n_lines, got[4].text, got[4].n_lines) == (None, 0, "", 1)
    assert got[5].text == long and got[6].text == ""
    assert drop_recurring_lines(docs_of([])).count() == 0


def test_repeated_rows_and_clashing_columns(docs_of):
    df = docs_of([(1, "a b\nc"), (1, "a b\nc"), (2, "a b"), (1, "a b")]).withColumn("leaf", F.lit(1))
    got = sorted((r.doc_id, r.text, r.leaf, r.n_dropped) for r in drop_recurring_lines(df, min_docs=2).collect())
    kept = [g for g in got if g[3] == 0]
    assert len(got) == 4 and all(g[2] == 1 for g in got)
    assert {g[0] for g in kept} == {1} and len({g[1] for g in kept}) == 1
    assert (2, "", 1, 1) in got


def test_columns_named_like_the_operators_own(docs_of):
    names = ["gone", "_doc", "_mark", "_lines", "lines", "row", "doc", "mark", "leaf", "kind", "long", "n_lines", "n_dropped"]
    df = docs_of([(i, "a b c d e f\nc") for i in range(3)]).withColumns({c: F.lit(c) for c in names})
    got = drop_recurring_lines(df, min_docs=2)
    assert sorted(got.columns) == sorted(df.columns)
    assert sorted((r.doc_id, r.text, r.gone, r.row, r.n_dropped) for r in got.collect()) == [
        (0, "a b c d e f\nc", "gone", "row", 0), (1, "", "gone", "row", 2), (2, "", "gone", "row", 2),
    ]


def test_body(spark):
    df = spark.createDataFrame([("  a\tb1 c ",), ("",), ("7",)], "line string")
    assert [r[0] for r in df.select(body_of(F.col("line"))).collect()] == ["a <*> c", "", "<*>"]


def test_lines_of_variable_tokens_stand_for_themselves(docs_of):
    rows = [(i, f"{i}.5 {i + 1} {i * 7}\n\u6587\u5b57{i}\u6bb5\u843d\u3002\nhttp://x.org/{i}\n12 34") for i in range(6)]
    got = run(docs_of(rows), min_docs=5)
    assert got[0].n_dropped == 0
    assert all(got[i].text == rows[i][1].removesuffix("\n12 34") and got[i].n_dropped == 1 for i in range(1, 6))


def test_fields_are_generalised_at_every_size(docs_of):
    # 40 x 40 values, each in 10 documents, each pair of them in one at most.
    place = lambda n: "".join(chr(97 + int(c)) for c in str(n))
    rows = [
        (i, f"This shop is open in {place(i % 40)} and also in {place((i * 7 + i // 40) % 40)} every single day")
        for i in range(400)
    ]
    assert len({t for _, t in rows}) == 400
    got = run(docs_of(rows))
    assert got[0].n_dropped == 0 and all(got[i].n_dropped == 1 for i in range(1, 400))
    few = run(docs_of(rows[:30]))
    assert all(few[i].n_dropped == 1 for i in range(1, 30))


def test_short_lines_with_an_equal_beginning(docs_of):
    ends = [f"{chr(97 + i)}x {chr(97 + i)}y" for i in range(6)]
    rows = [(i, f"One of the {e[:2]}\nOne of the {e}\nOne of the shops in town is {e[:2]}") for i, e in enumerate(ends)]
    got = run(docs_of(rows))
    assert got[0].n_dropped == 0
    assert all(got[i].text == rows[i][1].rsplit("\n", 1)[0] for i in range(1, 6))
    trees = [(i, f"One of the {t}") for i, t in enumerate(("alders", "beeches", "cedars", "dogwoods", "elms", "firs"))]
    assert all(r.n_dropped == 0 for r in run(docs_of(trees)).values())


def test_long_lines_recur_from_two_documents(docs_of):
    words = lambda c, n: " ".join(f"{c}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(n))
    passage, short = words("p", 51), words("s", 50)
    rows = [(i, f"{words('abc'[i], 60)}\n{passage}\n{short}") for i in range(3)]
    got = run(docs_of(rows))
    assert got[0].n_dropped == 0
    assert all(got[i].text == f"{words('abc'[i], 60)}\n{short}" for i in (1, 2))


def test_masking_costs_a_token_its_length(spark):
    """Whole tokens with a digit are masked, and a very long one without is passed over in one go."""
    import random
    import re
    import time

    from pyspark.sql import functions as F

    from peerglass.llm.line_dedup import body_of

    rng = random.Random(5)
    lines = ["".join(rng.choice("ab1 2\t\r\x0b\x0c  -é") for _ in range(rng.randrange(14))) for _ in range(2000)]
    df = spark.createDataFrame([(x,) for x in lines], "x string").select("x", body_of(F.col("x")).alias("y"))
    for x, y in df.collect():
        tokens = re.findall(r"[^\x20\x09-\x0D]+", x)
        assert y == " ".join("<*>" if re.search("[0-9]", t) else t for t in tokens)
    long = spark.createDataFrame([("7 " + "x" * 200_000,)], "x string").select(body_of(F.col("x")).alias("y"))
    began = time.time()
    assert long.collect()[0]["y"] == "<*> " + "x" * 200_000
    assert time.time() - began < 5
