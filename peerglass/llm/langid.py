"""Language by compression: the dictionary that packs a text smallest names it.

``learn`` draws a bounded sample of labelled texts per language (``rows`` texts, or
pieces of ``row_chars`` characters of longer ones, by a hash of id and text, spread over
all rows that have a label; equal rows count once) and lays them end to end as a
raw-content dictionary. ``classify`` packs every text whole, in pieces of ``piece``
characters, once per dictionary, and adds up the sizes; pieces keep the dictionary in
the window however long the text.

``score`` is the margin between the best two totals over the larger: 0 for a tie,
towards 1 the clearer. ``narrow_margin`` reads the margin to ask for off all labelled
texts that are not in the dictionaries: the greatest that leaves ``keep`` of those
rightly named. ``accepted`` is false for smaller margins and for undetermined texts.

Defined results: null text, and text without a letter, is ``und`` with score 0; so
is every text when nothing was learned. With one language learned, every text with
a letter is that language with score 1. Ties go to the first language by code
point. Repeated rows are classified alike; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peerglass.sources.tables import durable

UNDETERMINED = "und"
_LETTER = re.compile(r"[^\W\d_]")
_REST = re.compile(r"[\W\d_]+")


def letters(text: str) -> str:
    """Lower-case words between single spaces: what distinguishes languages."""
    return " " + _REST.sub(" ", text.lower()) + " "


def _sampled(labelled: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    return labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).alias("lang"),
        F.col(text_col).alias("text"),
        F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)).alias("place"),
    )


def _cuts(sampled: DataFrame, rows: int, checks: int, most_languages: int) -> dict[str, tuple[int, int]]:
    """Per language the places of its text number ``rows`` and number ``rows + checks``."""
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("place"))
    found = (
        sampled.select("lang", "place")
        .distinct()
        .withColumn("n", nth)
        .where(F.col("n") <= rows + checks)
        .groupBy("lang")
        .agg(F.max(F.when(F.col("n") <= rows, F.col("place"))).alias("cut"), F.max("place").alias("last"))
        .limit(most_languages + 1)
        .collect()
    )
    if len(found) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    return {row["lang"]: (row["cut"], row["last"]) for row in sorted(found)}


def _of(values: dict[str, int]) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))[F.col("lang")]


def learn(
    labelled: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    rows: int = 64,
    row_chars: int = 8_000,
    most_languages: int = 512,
    most_bytes: int = 128 * 2**20,
) -> dict[str, bytes]:
    """A dictionary per language, from at most ``rows`` texts each.

    Of a text over ``row_chars`` a piece of that length is taken, at an offset by a
    hash, so that languages of long texts are learned too. More than ``most_languages``
    labels are an error. The dictionaries are sent to every task: with so many
    languages that they could pass ``most_bytes`` together, pieces are shorter.
    """
    sampled = _sampled(labelled, id_col, text_col, lang_col)
    # The texts themselves are gathered only once the places that count are known.
    cuts = _cuts(sampled, rows, 0, most_languages)
    if not cuts:
        return {}
    width = max(1, min(row_chars, most_bytes // (4 * rows * len(cuts))))
    spare = F.length("text") - width
    at = F.pmod(F.xxhash64("place"), F.greatest(spare, F.lit(0)) + 1).cast("int") + 1
    piece = F.when(spare > 0, F.substring("text", at, F.lit(width))).otherwise(F.col("text"))
    texts: dict[str, list[tuple[int, str]]] = {lang: [] for lang in cuts}
    taken = sampled.where(F.col("place") <= _of({lang: cut for lang, (cut, _) in cuts.items()}))
    for row in taken.groupBy("lang", "place").agg(F.min(piece).alias("text")).toLocalIterator():
        texts[row["lang"]].append((row["place"], letters(row["text"])))
    return {lang: "".join(t for _, t in sorted(texts[lang])).encode() for lang in texts}


_BINS = 4096


def _at_rank(scores: DataFrame, rank: int) -> float:
    """The score of that rank, from 0; rows (score, n). Bins are cut finer until one score is left."""
    ends = scores.agg(F.min("score").alias("low"), F.max("score").alias("high")).first()
    low, high = ends["low"], ends["high"]
    while low < high:
        place = F.least(F.floor((F.col("score") - low) / (high - low) * _BINS), F.lit(_BINS - 1))
        bins = (
            scores.where(F.col("score").between(low, high))
            .groupBy(place.alias("bin"))
            .agg(F.sum("n").alias("n"), F.min("score").alias("low"), F.max("score").alias("high"))
            .collect()
        )
        for row in sorted(bins):
            if rank < row["n"]:
                low, high = row["low"], row["high"]
                break
            rank -= row["n"]
    return low


def narrow_margin(
    labelled: DataFrame,
    model: dict[str, bytes],
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    rows: int = 64,
    checks: int | None = None,
    keep: float = 0.99,
    least: float = 0.001,
    most_languages: int = 512,
) -> float:
    """The greatest margin that ``keep`` of the rightly named texts reach.

    Measured on every labelled text that is not in the dictionaries that ``learn``
    makes of the same rows with the same ``rows``, equal rows counting once; with
    ``checks`` on the next that many texts of a language only. Never under ``least``,
    which is the result where nothing is left to measure on.
    """
    sampled = _sampled(labelled, id_col, text_col, lang_col)
    cuts = _cuts(sampled, rows, checks or 0, most_languages)
    if not cuts:
        return least
    beyond = F.col("place") > _of({lang: cut for lang, (cut, _) in cuts.items()})
    if checks is not None:
        beyond &= F.col("place") <= _of({lang: last for lang, (_, last) in cuts.items()})
    named = sampled.where(beyond).select("lang", "place", classify(sampled, model).alias("found"))
    right = named.where("found.lang_pred = lang").groupBy("lang", "place").agg(F.min("found.score").alias("score"))
    scores = durable(right.groupBy("score").agg(F.count(F.lit(1)).alias("n")), "margins")
    total = scores.agg(F.sum("n")).first()[0]
    if not total:
        return least
    return max(least, _at_rank(scores, max(0, total - math.ceil(round(keep * total, 6)))))


@lru_cache(maxsize=4)
def _packers(model: tuple[tuple[str, bytes], ...], level: int) -> list[zstandard.ZstdCompressor]:
    made = []
    for _, content in model:
        dictionary = zstandard.ZstdCompressionDict(
            content, dict_type=zstandard.DICT_TYPE_RAWCONTENT
        )
        dictionary.precompute_compress(level=level)
        made.append(
            zstandard.ZstdCompressor(
                level=level, dict_data=dictionary, write_content_size=False, write_dict_id=False
            )
        )
    return made


def judge(
    text: str | None, model: tuple[tuple[str, bytes], ...], level: int = 3, piece: int = 4_000
) -> tuple[str, float]:
    """Language and margin of one text."""
    if not model or text is None or not _LETTER.search(text):
        return UNDETERMINED, 0.0
    packers = _packers(model, level)
    sizes = [0] * len(packers)
    low = letters(text)
    for at in range(0, len(low), piece):
        part = low[at : at + piece].encode("utf-8", "surrogatepass")
        for i, packer in enumerate(packers):
            sizes[i] += len(packer.compress(part))
    best = min(range(len(sizes)), key=sizes.__getitem__)
    if len(sizes) == 1:
        return model[0][0], 1.0
    second = min(s for i, s in enumerate(sizes) if i != best)
    return model[best][0], (second - sizes[best]) / second


def classify(
    documents: DataFrame,
    model: dict[str, bytes],
    *,
    text_col: str = "text",
    level: int = 3,
    piece: int = 4_000,
    min_margin: float = 0.001,
) -> Column:
    """Column expression: struct of lang_pred, score, accepted."""
    sent = documents.sparkSession.sparkContext.broadcast(tuple(model.items()))

    @F.pandas_udf("lang_pred string, score double, accepted boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = sent.value
        for texts in batches:
            found = [judge(t, known, level, piece) for t in texts]
            yield pd.DataFrame(
                {
                    "lang_pred": [lang for lang, _ in found],
                    "score": [margin for _, margin in found],
                    "accepted": [
                        lang != UNDETERMINED and margin >= min_margin for lang, margin in found
                    ],
                }
            )

    return run(F.col(text_col))
