from __future__ import annotations

import re
import zlib

import pytest
import zstandard
from pyspark.sql import functions as F

from peerglass.llm.langid import _at_rank, classify, judge, learn, narrow_margin
from peerglass.llm.queries import op5, trains


def predicted(df, model, **k):
    return [tuple(r[0]) for r in df.select(classify(df, model, **k)).collect()]


def test_held_out_accuracy(spark, sf_dir):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = [r for r in op5(spark, sf_dir).collect() if r.held_out]
    right = sum(r.lang_pred == lang[r.doc_id] for r in rows)
    assert right / len(rows) > 0.93
    assert all(0 <= r.score <= 1 for r in rows)


def test_defined_results(docs_of):
    de, en = "der und die das nicht " * 40, "the of and to with " * 40
    df = docs_of([(i, t * 2, lang, "s") for i, (t, lang) in enumerate([(de, "de"), (en, "en")] * 3)])
    model = learn(df)
    assert sorted(model) == ["de", "en"]
    tests = [en, de * 300, None, "", "12 !?", "THE, OF!! and", en]
    got = predicted(docs_of(list(enumerate(tests))), model)
    assert [g[0] for g in got] == ["en", "de", "und", "und", "und", "en", "en"]
    assert got[2] == ("und", 0.0, False) and got[0][2] and got[0] == got[6]
    assert predicted(docs_of([(1, en)]), model, min_margin=1.0)[0][2] is False
    assert predicted(docs_of([]), model) == []


def test_few_or_no_languages(docs_of):
    unlabelled = docs_of([(1, "text", None, "s"), (2, None, "en", "s")])
    assert learn(unlabelled) == {}
    assert judge("text", ()) == ("und", 0.0)
    assert judge("text", (("en", b"some"),)) == ("en", 1.0)
    with pytest.raises(ValueError):
        learn(docs_of([(i, "t", f"l{i}", "s") for i in range(5)]), most_languages=4)


def test_sample_is_bounded(docs_of):
    rows = [(i, f"text {i} " + "x" * (i % 50), "en", "s") for i in range(300)]
    model = learn(docs_of(rows), rows=10)
    assert model["en"].count(b"text") == 10
    assert model == learn(docs_of(rows).repartition(5), rows=10)


def test_languages_of_long_texts_are_learned(docs_of):
    de, en = "der und die das nicht " * 40, "the of and to with " * 900
    df = docs_of([(i, t, lang, "s") for i, (t, lang) in enumerate([(de, "de"), (en, "en"), (en[4:], "en"), (en[7:], "en")])])
    model = learn(df)
    assert sorted(model) == ["de", "en"] and 20_000 < len(model["en"]) <= 3 * 8_002
    assert [g[0] for g in predicted(docs_of([(1, de), (2, en)]), model)] == ["de", "en"]


def test_equal_rows_count_once(docs_of):
    same = [(1, "one and the same text", "en", "s")] * 5000
    assert learn(docs_of(same)) == {"en": b" one and the same text "}
    assert learn(docs_of(same + [(0, "another", "en", "s")]))["en"].count(b"another") == 1


def test_many_languages_share_the_bytes(docs_of):
    rows = [(i, "abcdefgh " * 900, f"l{i}", "s") for i in range(8)]
    model = learn(docs_of(rows), rows=4, most_bytes=4 * 4 * 8 * 100)
    assert len(model) == 8 and all(0 < len(d) <= 102 for d in model.values())


def sizes(text, model, level=3, piece=4000):
    """By definition: one new compressor per piece and language."""
    low = " " + re.sub(r"[\W\d_]+", " ", text.lower()) + " "
    out = {}
    for lang, content in model.items():
        packer = zstandard.ZstdCompressor(
            level=level,
            dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT),
            write_content_size=False,
            write_dict_id=False,
        )
        out[lang] = sum(len(packer.compress(low[i : i + piece].encode())) for i in range(0, len(low), piece))
    return out


def test_sizes_margin_and_choice_by_definition(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    known = docs.where(trains())
    model = learn(known)
    margin = narrow_margin(known, model)
    wanted = {}
    for r in docs.collect():
        if r.text is None or not re.search(r"[^\W\d_]", r.text):
            wanted[r.doc_id] = ("und", 0.0, False)
            continue
        found = sorted((size, lang) for lang, size in sizes(r.text, model).items())
        (best, lang), (second, _) = found[:2]
        score = (second - best) / second
        wanted[r.doc_id] = (lang, score, score >= margin)
    got = {r.doc_id: (r.lang_pred, r.score, r.accepted) for r in op5(spark, sf_dir).collect()}
    assert got == wanted


def test_margin_keeps_the_share_of_right_texts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    known = docs.where(trains())
    few = {"rows": 8}
    model = learn(known, **few)
    tight, loose = (narrow_margin(known, model, keep=k, checks=10**6, **few) for k in (0.5, 0.9))
    assert tight > loose >= 0.001
    places = {}
    rows = known.where("lang IS NOT NULL AND text IS NOT NULL").select(
        "lang", "text", F.xxhash64(F.col("doc_id").cast("string"), "text").alias("p")
    )
    for r in rows.distinct().orderBy("p").collect():
        places.setdefault(r.lang, []).append(r.text)
    found = [(lang, judge(t, tuple(model.items()))) for lang, texts in places.items() for t in texts[8:]]
    scores = [score for lang, (named, score) in found if named == lang]
    for share, margin in ((0.5, tight), (0.9, loose)):
        assert sum(s > margin for s in scores) <= share * len(scores) <= sum(s >= margin for s in scores)
    assert narrow_margin(known.where("false"), model) == 0.001 == narrow_margin(known, {}, **few)


def test_only_two_thirds_are_learned_from(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", trains().alias("t")).collect()
    assert all(r.t == (zlib.crc32(str(r.doc_id).encode()) % 3 != 1) for r in rows)


def test_margin_is_measured_on_all_labelled_texts(docs_of):
    """No bounded share of them: by definition over every text beyond the dictionaries."""
    words = {"de": "der die das und nicht haus", "en": "the and not house of with"}
    rows = [
        (2 * i + j, " ".join(w.split()[(i * k) % 6] for k in range(1, 4 + i % 9)) + f" {i}x", lang, "s")
        for i in range(900)
        for j, (lang, w) in enumerate(words.items())
    ]
    known = docs_of(rows + rows[:50])
    model = learn(known, rows=2)
    margin = narrow_margin(known, model, rows=2, keep=0.73)
    places: dict = {}
    marked = known.select("lang", "text", F.xxhash64(F.col("doc_id").cast("string"), "text").alias("p"))
    for r in marked.distinct().orderBy("p").collect():
        places.setdefault(r.lang, []).append(r.text)
    found = [(lang, judge(t, tuple(model.items()))) for lang, texts in places.items() for t in texts[2:]]
    scores = [score for lang, (named, score) in found if named == lang]
    assert len(scores) > 4 * 256
    assert margin in scores
    assert sum(s > margin for s in scores) <= 0.73 * len(scores) <= sum(s >= margin for s in scores)


def test_score_of_a_rank(spark):
    values = [0.1, 0.1, 0.1, 0.1 + 1e-15, 0.2, 0.9, 0.9]
    scores = spark.createDataFrame([(v, values.count(v)) for v in set(values)], "score double, n long")
    assert [_at_rank(scores, i) for i in range(7)] == values
