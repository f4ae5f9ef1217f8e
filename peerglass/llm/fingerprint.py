"""Document fingerprints from closed syncmers.

A k-mer of characters is an anchor when the smallest hash among its inner s-mers
lies at either edge. Whether it is one depends on the k-mer alone, so an edit only
touches the anchors that overlap it, and equal passages have equal anchors at
equal distances. A fingerprint is the anchors' hashes in text order, eight hex
digits each; likeness of two fingerprints is the Jaccard similarity of their sets
of anchors. About two in ``k - s + 1`` characters begin an anchor.

Defined results: null text is empty and has the empty fingerprint; a text without
an anchor (shorter than k, or just over it) is one anchor as a whole; two empty
fingerprints are alike (1), an empty and another are not (0). Repeated rows have
equal fingerprints.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K, S = 20, 6
_BASE = 0x9E3779B97F4A7C15
_WORD = 2**64


def _rolling(codes: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hash of every run of n codes, from runs of half the length."""
    if n == 1:
        return codes
    half = n // 2
    left, right = _rolling(codes, n - half), _rolling(codes, half)
    shift = np.uint64(pow(_BASE, half, _WORD))
    end = len(codes) - n + 1
    return left[:end] * shift + right[n - half : n - half + end]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    reach, out = 1, h
    while reach * 2 <= width:
        out = np.minimum(out[:-reach], out[reach:])
        reach *= 2
    if rest := width - reach:
        out = np.minimum(out[:-rest], out[rest:])
    return out


def anchors(text: str, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Positions and 32-bit hashes of a text's closed syncmers, in text order."""
    codes = np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    n = len(codes)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint32)
    if n >= k:
        inner = _mixed(_rolling(codes, s))
        least = _sliding_min(inner, k - s + 1)
        at = np.flatnonzero((inner[: len(least)] == least) | (inner[k - s :] == least))
        if len(at):
            whole = _mixed(_rolling(codes, k)[at])
            return at, (whole >> np.uint64(32)).astype(np.uint32)
    digest = hashlib.blake2b(text.encode(), digest_size=4).digest()
    return np.zeros(1, np.int64), np.frombuffer(digest, dtype=">u4").astype(np.uint32)


def as_string(hashes: np.ndarray) -> str:
    return hashes.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of sorted distinct anchors."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def in_place(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> int:
    """Number of anchors that two texts have at the same positions."""
    key = lambda x: (x[0].astype(np.uint64) << np.uint64(32)) | x[1].astype(np.uint64)
    return len(np.intersect1d(key(a), key(b), assume_unique=True))


def edited(text: str, following: str) -> str:
    """The last third replaced by as much of the next text's beginning, or all of it."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double, n_anchors long, "
    "anchors_in_place long"
)


class _Read:
    """A text with what is drawn from it once."""

    def __init__(self, doc_id: int | None, text: str, k: int, s: int):
        self.doc_id, self.text = doc_id, text
        self.placed = anchors(text, k, s)
        self.distinct = np.unique(self.placed[1])


def _compared(doc: _Read, following: _Read, k: int, s: int) -> tuple:
    changed = _Read(None, edited(doc.text, following.text), k, s)
    return (
        doc.doc_id,
        len(doc.text),
        hashlib.sha256(changed.text.encode()).hexdigest(),
        as_string(doc.placed[1]),
        as_string(changed.placed[1]),
        likeness(doc.distinct, changed.distinct),
        likeness(doc.distinct, following.distinct),
        len(doc.placed[1]),
        in_place(doc.placed, changed.placed),
    )


def fingerprint_with_next(
    documents: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    k: int = K,
    s: int = S,
    blocks: int | None = None,
) -> DataFrame:
    """Fingerprints of every text and of its edit with the next document's text.

    Next is by descending id, null ids last, the first after the last; rows that
    repeat an id follow one another in order of a hash of their text. Ids are first
    cut into ranges by themselves (without the texts); then every text is dealt
    once to its range, and the first document of a range also to the range before
    it, so that each range can be read through in order without its neighbours.
    The driver sees one pair of ids per range.
    """
    spark = documents.sparkSession
    least = -(2**63)  # stands for null, which comes last
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(least))
    n = blocks or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ends = sorted(
        (row["low"], row["high"])
        for row in documents.select(key.alias("id"))
        .repartitionByRange(n, "id")
        .groupBy(F.spark_partition_id())
        .agg(F.min("id").alias("low"), F.max("id").alias("high"))
        .collect()
    )
    lows, highs = (np.array([e[i] for e in ends], dtype=np.int64) for i in (0, 1))

    @F.pandas_udf("array<int>")
    def ranges(found: pd.Series) -> pd.Series:
        """The range of an id, and the range after it if it begins one, read downwards."""
        key = found.to_numpy(dtype=np.int64)
        at = np.searchsorted(lows, key, side="right") - 1
        first = highs[at] == key
        return pd.Series(
            [[a, (a + 1) % len(lows)] if f else [a] for a, f in zip(at, first, strict=True)]
        )

    dealt = (
        documents.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.coalesce(F.col(text_col), F.lit("")).alias("text"),
            ranges(key).alias("_ranges"),
        )
        .select("doc_id", "text", F.posexplode("_ranges").alias("lent", "range"))
        .repartition("range")
        .sortWithinPartitions("range", "lent", F.desc_nulls_last("doc_id"), F.xxhash64("text"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the document that waits for its next one
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part, out = batch.slice(at, _ROWS), []
                for doc_id, text, lent in zip(
                    *(part.column(c).to_pylist() for c in ("doc_id", "text", "lent")), strict=True
                ):
                    if lent and held is None:
                        continue
                    doc = _Read(doc_id, text, k, s)
                    if held is not None:
                        out.append(_compared(held, doc, k, s))
                    held = None if lent else doc
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(v, f.type) for v, f in zip(zip(*out), _FIELDS)], schema=_FIELDS
                    )

    return dealt.mapInArrow(run, SCHEMA)


_ROWS = 256  # results that are held before they are passed on
_FIELDS = pa.schema(
    [
        (name, {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[kind])
        for name, kind in (field.split() for field in SCHEMA.split(", "))
    ]
)
