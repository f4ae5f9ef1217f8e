"""Alignment of two tokenizers over the same text.

A and B cut the bytes of " " + text in different places. Bytes where both end a token
cut the tokens into groups; every A token of a group is linked with every B token of
it. How many documents hold an id pair linked is counted over the corpus.

Merging: the token ends of a chunk of documents are two sorted lists. Diagonals of
their merge at equal distances are found by binary search, which divides it into
pieces of equal work whatever the documents' lengths. A piece sees its own ends only
and emits the ends that both lists hold; tokens before its first and after its last
shared end belong to groups that other pieces begin or finish, and are stitched to
them. A text is tokenised whole by one task, so its pieces are merged there, too: to
move them would cost more than the merge.

Counting: a block of documents (about ``BLOCK_CHARS`` characters) names its distinct
pairs once and its documents refer to them by place. So what meets the corpus counts
is a row per block and pair, not per document and pair. A block is stored in rows of
bounded size, and a task holds one block at a time. The best count of each A id is
a table of at most the vocabulary's size, which is checked before it is broadcast.

Defined results: null and empty texts, and texts whose tokens do not give back the
bytes of " " + text, have no tokens and zeros. Strings of special tokens are plain
text. Rows that repeat an id are documents of their own. An empty table gives an empty
result; further columns are ignored. Of a very long text A is encoded in parts, cut at
spaces between ASCII letters or digits, where its tokens end in any case.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from peerglass.llm.tokens import byte_of_letter
from peerglass.sources.tables import durable

PIECE = 2**16  # token ends per piece of a merge
CHUNK_CHARS = 2**20  # characters tokenised together, if no text is longer
BLOCK_CHARS = 2**23
PART = 2**16  # pairs in a stored row at most
MOST_BEST = 2**20  # ids of A whose best counts may be broadcast
_LINKS = 2**22  # links written out at once
# Fixed value: how byte-level vocabularies cut a text into words before they merge bytes.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_NOT_LATIN = re.compile("[^\x00-\u024f]")
_BREAK = re.compile("(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")


# ------------------------------------------------------------------- vocabularies
class Vocabularies:
    """Both tokenizers, and the bytes of every id."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=b_path)
        letters = byte_of_letter()
        with open(a_path, encoding="utf-8") as f:
            file = json.load(f)
        added = {t["id"] for t in file.get("added_tokens", [])}
        entries = {i: t for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.a_bytes = [b""] * (max(entries) + 1)
        for i, t in entries.items():
            self.a_bytes[i] = t.encode() if i in added else bytes(letters[c] for c in t)
        self.fast_a = self._ranked(file["model"], added)
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.size = (len(self.a_bytes), len(self.b_bytes))
        self.a_length = np.array([len(x) for x in self.a_bytes], dtype=np.int64)
        self.b_length = np.array([len(x) for x in self.b_bytes], dtype=np.int64)
        # Texts of ids with what follows them: "," inside a list, "|" after A's, ";" after B's.
        written = [f"{i}{mark}" for n, end in zip(self.size, "|;", strict=True) for mark in "," + end for i in range(n)]
        self.written = np.array(written, dtype=object)

    def _ranked(self, model: dict, added: set[int]) -> tiktoken.Encoding | None:
        """The same vocabulary by ranks, which is several times faster, where ids follow the merges' order.

        Used for Latin texts only: what counts as a letter elsewhere depends on the
        libraries' versions of Unicode.
        """
        merged = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        if any(model["vocab"][x + y] != 256 + i for i, (x, y) in enumerate(merged)):
            return None
        ranks = {t: i for i, t in enumerate(self.a_bytes) if i not in added}
        return tiktoken.Encoding("ranked", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def encode_a(self, text: str) -> list[int]:
        parts, at = [], 0
        while len(text) - at > CHUNK_CHARS and (cut := _BREAK.search(text, at + CHUNK_CHARS // 2)):
            parts.append(text[at : cut.start()])
            at = cut.start()
        return [i for p in (*parts, text[at:]) for i in self.a.encode(p, add_special_tokens=False).ids]

    def encode(self, texts: list[str]) -> Iterator[tuple[list[int], list[int]]]:
        spaced = [" " + t for t in texts]
        a = [
            self.fast_a.encode_ordinary(t) if self.fast_a and not _NOT_LATIN.search(t) else self.encode_a(t)
            for t in spaced
        ]
        for text, x, y in zip(spaced, a, self.b.encode(texts, num_threads=1), strict=True):
            whole = text.encode()
            same = b"".join(map(self.a_bytes.__getitem__, x)) == whole == b"".join(map(self.b_bytes.__getitem__, y))
            yield (x, y) if same else ([], [])


@lru_cache(maxsize=2)
def _vocabularies(a_path: str, b_path: str) -> Vocabularies:
    return Vocabularies(a_path, b_path)  # one per Python worker


# ------------------------------------------------------------------------- merging
def diagonals(a: np.ndarray, b: np.ndarray, piece: int) -> tuple[np.ndarray, np.ndarray]:
    """Where pieces begin in a and b (and where the last one ends), a's ends first among equals.

    For diagonal d the least i with a[i] > b[d - i - 1] splits the first d of the
    merge into i of a and d - i of b. An end of b equal to the last of a before the
    cut goes with it, so that no shared end lies in two pieces.
    """
    d = np.append(np.arange(0, len(a) + len(b), piece), len(a) + len(b))
    low, high = np.maximum(d - len(b), 0), np.minimum(d, len(a))
    while (low < high).any():
        mid = (low + high) // 2
        open_ = low < high
        before = np.zeros(len(d), dtype=bool)
        before[open_] = a[mid[open_]] <= b[(d - mid - 1)[open_]]
        low = np.where(open_ & before, mid + 1, low)
        high = np.where(open_ & ~before, mid, high)
    i, j = low, d - low
    tie = (i > 0) & (j < len(b))
    tie[tie] = a[i[tie] - 1] == b[j[tie]]
    return i, j + tie


def shared_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a and in b of the ends that both hold, of one piece."""
    at = np.searchsorted(b, a)
    hit = np.flatnonzero(at < len(b))
    hit = hit[b[at[hit]] == a[hit]]
    return hit, at[hit]


def group_ends(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """Number of tokens of A and of B up to the end of each group.

    Every piece gives the ends of groups that end in it. A group's beginning is the
    end of the one before, found in whatever earlier piece: this stitches groups that
    pieces cut, or that run through several.
    """
    if not len(a) or not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, j = diagonals(a, b, piece)
    out = []
    for k in range(len(i) - 1):
        x, y = shared_ends(a[i[k] : i[k + 1]], b[j[k] : j[k + 1]])
        out.append((x + i[k] + 1, y + j[k] + 1))
    return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])


# ----------------------------------------------------------------- chunks of documents
@dataclass
class Chunk:
    """Aligned documents: their tokens in one row, and their groups."""

    a: np.ndarray
    b: np.ndarray
    n_a: np.ndarray  # per document
    n_b: np.ndarray
    a_end: np.ndarray  # per group: tokens up to its end, over the chunk
    b_end: np.ndarray
    byte_end: np.ndarray
    doc: np.ndarray  # per group

    @property
    def a_begin(self) -> np.ndarray:
        return np.concatenate([[0], self.a_end[:-1]]).astype(np.int64)[: len(self.a_end)]

    @property
    def b_begin(self) -> np.ndarray:
        return np.concatenate([[0], self.b_end[:-1]]).astype(np.int64)[: len(self.b_end)]


def align_texts(texts: list[str | None], known: Vocabularies, piece: int = PIECE) -> Chunk:
    there = [i for i, t in enumerate(texts) if t]
    n_a, n_b = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    a, b = [], []
    for i, (x, y) in zip(there, known.encode([texts[i] for i in there]), strict=True):
        n_a[i], n_b[i] = len(x), len(y)
        a.append(np.array(x, dtype=np.int64))
        b.append(np.array(y, dtype=np.int64))
    a = np.concatenate(a) if a else np.zeros(0, np.int64)
    b = np.concatenate(b) if b else np.zeros(0, np.int64)
    # All documents' bytes one after the other: a document's end is an end of both.
    ends_a, ends_b = np.cumsum(known.a_length[a]), np.cumsum(known.b_length[b])
    a_end, b_end = group_ends(ends_a, ends_b, piece)
    doc = np.searchsorted(np.cumsum(n_a), a_end - 1, side="right")
    return Chunk(a, b, n_a, n_b, a_end, b_end, ends_a[a_end - 1], doc)


def group_hashes(c: Chunk, known: Vocabularies) -> list[str]:
    """SHA-256 of each document's groups as text; '' without tokens."""
    size_a, size_b = known.size
    group_a = np.repeat(np.arange(len(c.a_end)), c.a_end - c.a_begin)
    group_b = np.repeat(np.arange(len(c.b_end)), c.b_end - c.b_begin)
    codes = np.empty(len(c.a) + len(c.b), dtype=np.int64)
    last_a, last_b = np.zeros(len(c.a), bool), np.zeros(len(c.b), bool)
    last_a[c.a_end - 1] = last_b[c.b_end - 1] = True
    codes[np.arange(len(c.a)) + c.b_begin[group_a]] = c.a + last_a * size_a
    codes[np.arange(len(c.b)) + c.a_end[group_b]] = 2 * size_a + c.b + last_b * size_b
    words, out, at = known.written[codes], [], 0
    for n in (c.n_a + c.n_b).tolist():
        text = "".join(words[at : at + n].tolist())
        out.append(hashlib.sha256(text[:-1].encode()).hexdigest() if n else "")
        at += n
    return out


def linked_pairs(c: Chunk, size_b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, pair, links): how often a document links each id pair; pair is a * size_b + b."""
    n, m = c.a_end - c.a_begin, c.b_end - c.b_begin
    links = n * m
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(doc: np.ndarray, pair: np.ndarray, times: np.ndarray | None = None) -> None:
        order = np.lexsort((pair, doc))
        doc, pair = doc[order], pair[order]
        first = np.flatnonzero(np.append(True, (np.diff(doc) != 0) | (np.diff(pair) != 0))[: len(doc)])
        times = np.ones(len(doc), np.int64) if times is None else times[order]
        found.append((doc[first], pair[first], np.add.reduceat(times, first) if len(first) else times))

    small = np.flatnonzero(links <= _LINKS)
    for part in np.split(small, np.flatnonzero(np.diff(np.cumsum(links[small]) // _LINKS)) + 1):
        each = links[part]
        g = np.repeat(part, each)
        k = np.arange(len(g)) - np.repeat(np.cumsum(each) - each, each)
        add(c.doc[g], c.a[c.a_begin[g] + k // m[g]] * size_b + c.b[c.b_begin[g] + k % m[g]])
    for g in np.flatnonzero(links > _LINKS):  # by distinct ids, a few of A at a time
        x, nx = np.unique(c.a[c.a_begin[g] : c.a_end[g]], return_counts=True)
        y, ny = np.unique(c.b[c.b_begin[g] : c.b_end[g]], return_counts=True)
        step = max(1, _LINKS // len(y))
        for at in range(0, len(x), step):
            pair = (x[at : at + step, None] * size_b + y).ravel()
            add(np.full(len(pair), c.doc[g]), pair, (nx[at : at + step, None] * ny).ravel())
    if len(found) > 1:
        doc, pair, times = (np.concatenate([f[i] for f in found]) for i in range(3))
        found = []
        add(doc, pair, times)
    return found[0] if found else tuple(np.zeros(0, np.int64) for _ in range(3))


def _chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list, list]]:
    """Ids and texts of rows in chunks of about so many characters."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if texts and size + len(text or "") > most:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(doc)
            texts.append(text)
            size += len(text or "") + 1
    if texts:
        yield ids, texts


def _read(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


# ------------------------------------------------------------------------ operators
def align(
    documents: DataFrame, a_path: str, b_path: str, *, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, a_ids, b_ids, groups) per document; a group is (a_end, b_end, byte_end), counted from its start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _vocabularies(a_path, b_path)
        for ids, texts in _chunks(batches, CHUNK_CHARS):
            c = align_texts(texts, known)
            at_a, at_b = np.cumsum(c.n_a) - c.n_a, np.cumsum(c.n_b) - c.n_b
            bytes_ = np.array([len(t.encode()) + 1 if n else 0 for t, n in zip(texts, c.n_a, strict=True)])
            at_byte = np.cumsum(bytes_) - bytes_
            lists = lambda values, n: pa.ListArray.from_arrays(
                pa.array(np.append(0, np.cumsum(n)), pa.int32()), values
            )
            ends = [
                pa.array(x - at[c.doc], pa.int64())
                for x, at in ((c.a_end, at_a), (c.b_end, at_b), (c.byte_end, at_byte))
            ]
            groups = pa.StructArray.from_arrays(ends, ["a_end", "b_end", "byte_end"])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    lists(pa.array(c.a, pa.int32()), c.n_a),
                    lists(pa.array(c.b, pa.int32()), c.n_b),
                    lists(groups, np.bincount(c.doc, minlength=len(ids))),
                ],
                names=["doc_id", "a_ids", "b_ids", "groups"],
            )

    return _read(documents, id_col, text_col).mapInArrow(
        run,
        "doc_id long, a_ids array<int>, b_ids array<int>, "
        "groups array<struct<a_end: bigint, b_end: bigint, byte_end: bigint>>",
    )


_PER_DOC = ("n_a", "n_b", "n_groups", "n_links")
# Rows of a block: a document's first row has its figures, further ones more of its pairs; rows without a document
# name the block's pairs from place ``at`` on. No row has more than ``PART`` pairs, however large block or document.
_BLOCK = pa.schema(
    [("block", pa.int64()), ("doc", pa.int32()), ("doc_id", pa.int64())]
    + [(c, pa.int64()) for c in _PER_DOC]
    + [("groups_sha256", pa.string()), ("place", pa.binary()), ("times", pa.binary())]
    + [("at", pa.int64()), ("pair", pa.list_(pa.int64())), ("held", pa.list_(pa.int64()))]
)
_BLOCK_SQL = (
    "block long, doc int, doc_id long, "
    + ", ".join(f"{c} long" for c in _PER_DOC)
    + ", groups_sha256 string, place binary, times binary, at long, pair array<long>, held array<long>"
)


class _Block:
    """Documents whose pairs are named once."""

    def __init__(self):
        self.docs: dict[str, list] = {c: [] for c in ("doc_id", *_PER_DOC, "groups_sha256", "n_pairs")}
        self.pairs: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.chars = 0

    def add(self, ids: list, texts: list, known: Vocabularies) -> None:
        c = align_texts(texts, known)
        doc, pair, times = linked_pairs(c, known.size[1])
        count = lambda of, weight=None: np.bincount(of, weight, minlength=len(ids)).astype(np.int64).tolist()
        links = np.zeros(len(ids), np.int64)
        np.add.at(links, doc, times)
        for name, values in (
            ("doc_id", ids), ("n_a", c.n_a.tolist()), ("n_b", c.n_b.tolist()), ("n_groups", count(c.doc)),
            ("n_links", links.tolist()), ("groups_sha256", group_hashes(c, known)), ("n_pairs", count(doc)),
        ):
            self.docs[name] += values
        self.pairs.append(pair)
        self.times.append(times)
        self.chars += sum(len(t or "") for t in texts)

    def rows(self, number: int) -> Iterator[pa.RecordBatch]:
        pair, place, held = np.unique(np.concatenate(self.pairs), return_inverse=True, return_counts=True)
        n = np.array(self.docs["n_pairs"], dtype=np.int64)
        parts = np.maximum(-(-n // PART), 1)
        doc = np.repeat(np.arange(len(n)), parts)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
        begin = (np.cumsum(n) - n)[doc] + nth * PART
        end = np.minimum(begin + PART, np.cumsum(n)[doc])
        first = [d if k == 0 else None for d, k in zip(doc.tolist(), nth.tolist(), strict=True)]
        values = {c: [None if d is None else self.docs[c][d] for d in first] for c in self.docs if c != "n_pairs"}
        for name, numbers in (("place", place.astype("<i4")), ("times", np.concatenate(self.times).astype("<i8"))):
            values[name] = [numbers[i:j].tobytes() for i, j in zip(begin, end, strict=True)]
        yield self._batch(len(doc), {"block": [number] * len(doc), "doc": doc} | values)
        for at in range(0, len(pair), PART):
            named = {"pair": [pair[at : at + PART]], "held": [held[at : at + PART]]}
            yield self._batch(1, {"block": [number], "at": [at]} | named)

    @staticmethod
    def _batch(n: int, values: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(values[f.name], f.type) if f.name in values else pa.nulls(n, f.type) for f in _BLOCK],
            schema=_BLOCK,
        )


def _blocks(documents: DataFrame, a_path: str, b_path: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _vocabularies(a_path, b_path)
        task, n, block = TaskContext.get().partitionId(), 0, _Block()
        for ids, texts in _chunks(batches, CHUNK_CHARS):
            block.add(ids, texts, known)
            if block.chars >= BLOCK_CHARS:
                yield from block.rows((task << 32) + n)
                n, block = n + 1, _Block()
        if block.pairs:
            yield from block.rows((task << 32) + n)

    return durable(documents.mapInArrow(run, _BLOCK_SQL), "align-blocks", compression="zstd")


_OUT = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
)


def _summed(rows: pa.Table, counted: pa.Table) -> pa.Table:
    """A row per document of a block: its links' counts, and how many of them are their A id's best."""
    rows = rows.sort_by([("doc", "ascending"), ("n_a", "ascending")])  # nulls last: a document's first row leads
    place = np.frombuffer(b"".join(rows["place"].to_pylist()), dtype="<i4")
    times = np.frombuffer(b"".join(rows["times"].to_pylist()), dtype="<i8")
    edges = np.append(0, np.cumsum(pc.binary_length(rows["place"]).to_numpy() // 4))
    count, best = np.zeros((2, int(place.max(initial=-1)) + 1), dtype=np.int64)
    at = counted["at"].to_numpy()
    count[at], best[at] = counted["n"].to_numpy(), counted["is_best"].to_numpy()
    docs = rows.filter(pc.is_valid(rows["n_a"]))
    begins = edges[:-1][pc.is_valid(rows["n_a"]).to_numpy()]
    values = {}
    for name, per_pair in (("count_sum", count), ("n_best", best)):
        sums = np.append(0, np.cumsum(per_pair[place] * times))
        values[name] = pa.array(np.diff(np.append(sums[begins], sums[-1])), pa.int64())
    return pa.table({c: values[c] if c in values else docs[c] for c in (c.split()[0] for c in _OUT.split(", "))})


def link_counts(
    documents: DataFrame, a_path: str, b_path: str, *, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    blocks = _blocks(_read(documents, id_col, text_col), a_path, b_path)
    size_a, size_b = _vocabularies(a_path, b_path).size
    named = (
        blocks.where("at IS NOT NULL")
        .select("block", "at", F.posexplode(F.arrays_zip("pair", "held")).alias("nth", "of"))
        .select("block", (F.col("at") + F.col("nth")).alias("at"), "of.*")
    )
    counts = (
        named.groupBy("pair")
        .agg(F.sum("held").alias("n"))
        .withColumn("a", F.expr(f"pair div {size_b}"))
    )
    counts = durable(counts, "align-counts")
    best = counts.groupBy("a").agg(F.max("n").alias("best"))
    if size_a <= MOST_BEST:  # a row per id of A
        best = F.broadcast(best)
    counted = named.join(counts.join(best, "a"), "pair").select(
        F.col("block").alias("_block"), "at", "n", (F.col("n") == F.col("best")).alias("is_best")
    )
    rows = blocks.where("doc IS NOT NULL").drop("at", "pair", "held")
    return rows.groupBy("block").cogroup(counted.groupBy("_block")).applyInArrow(_summed, _OUT)
