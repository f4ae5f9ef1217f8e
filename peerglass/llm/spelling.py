"""Spelling variants: words one edit apart, and the frequent form each is a slip of.

Two words are near if one code point inserted, deleted or replaced turns one into
the other, that is, if their common prefix and suffix together reach the longer
length minus one.

Which words meet: a pair whose shorter word has m code points differs within one of
the gaps that m falls into (of ``GAP`` code points, at most ``MOST`` gaps), and
agrees before and after it. So every word has a key per gap, as the shorter and as
the longer of a pair, and words of equal keys form a group. A group's words differ in
a short gap only, which bounds it by the alphabet and not by the corpus. Groups
of over ``TILE`` words are cut into blocks, and every two blocks meet in a tile of
their own, so that a hot group is spread over tasks.

Inside a task, blocks of ``BLOCK`` words become padded code-point matrices, left-
and right-aligned, and common prefixes and suffixes of all rows against all rows are
counted column by column. A pair is reported by the group of the gap where its
prefix ends, hence once.

A word's form is its near word of largest count (ties: the least in code-point
order), if that count is at least ``ratio`` times its own; else null. Counts grow by
the ratio along a chain of forms, so chains are short, and roots are found by
doubling them.

Defined results: null and empty words take no part; counts of a repeated word add up;
an empty table gives an empty result; further columns are ignored. Words of any
length are compared whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peerglass.sources.tables import durable

GAP, MOST = 3, 8
TILE, BLOCK, CELLS = 2048, 128, 2**20

RUN = "[A-Za-zÀ-ÿ]"  # letters of a word
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def counted_words(
    documents: DataFrame,
    *,
    least_length: int = 7,
    least_count: int = 2,
    slip_every: int | None = 31,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(word, n) of the texts' runs of letters, A-Z lower-cased.

    With ``slip_every`` a code point is left out of those runs whose checksum (of id
    and run) that number divides, which plants misspellings. Counts are combined
    before they are shuffled. A null id is written as nothing, null text has no words.
    """
    runs = documents.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("doc"),
        F.explode(
            F.regexp_extract_all(F.col(text_col), F.lit(f"({RUN}{{{least_length},}})"), F.lit(1))
        ).alias("run"),
    ).withColumn("run", F.translate("run", UPPER, LOWER))
    word = F.col("run")
    if slip_every:
        mark = F.crc32(F.concat_ws(":", "doc", "run"))
        at = (mark % F.length("run")).cast("int")
        slip = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
        word = F.when(mark % slip_every == 0, slip).otherwise(word)
    return (
        runs.select(word.alias("word"))
        .where(F.length("word") >= least_length)
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= least_count)
    )


def _gaps(m: Column) -> Column:
    """Number of gaps of a shorter word of m code points."""
    return F.least(F.ceil(m / GAP), F.lit(MOST)).cast("int")


def _keyed(words: DataFrame) -> DataFrame:
    """A row per key: key, shorter length m, gap s, word, n, size."""
    m, s = F.col("m"), F.col("s")
    start, end = F.floor(s * m / _gaps(m)), F.floor((s + 1) * m / _gaps(m))
    parts = (F.substring("word", F.lit(1), start.cast("int")), F.expr("right(word, cast(m - _end as int))"))
    return (
        words.withColumn("size", F.length("word"))
        .withColumn("m", F.explode(F.array(F.col("size"), F.col("size") - 1)))
        .where("m > 0")
        .withColumn("s", F.explode(F.sequence(F.lit(0), _gaps(m) - 1)))
        .withColumn("_end", end)
        .select(F.xxhash64("m", "s", *parts).alias("key"), "m", "s", "word", "n", "size")
    )


def _tiled(keyed: DataFrame) -> DataFrame:
    """Rows of groups in which words can meet, dealt to tiles of bounded size."""
    groups = (
        keyed.groupBy("key")
        .agg(F.count("*").alias("held"), F.max((F.col("size") == F.col("m")).cast("int")).alias("short"))
        .where("held > 1 AND short = 1")
        .select("key", F.ceil(F.col("held") / TILE).cast("int").alias("blocks"))
    )
    own = F.pmod(F.xxhash64("word", "m"), F.col("blocks")).cast("int")
    tiles = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda j: F.struct(F.least(F.col("own"), j).alias("i"), F.greatest(F.col("own"), j).alias("j")),
    )
    return (
        keyed.join(groups, "key")
        .withColumn("own", own)
        .select("key", "m", "s", "word", "n", "size", "own", F.inline(tiles))
        .repartition("key", "i", "j")
        .sortWithinPartitions("key", "i", "j")
    )


class _Words:
    """Rows of whole tiles and their comparison."""

    def __init__(self, rows: pa.Table):
        self.text = rows.column("word").to_pylist()
        num = {c: rows.column(c).to_numpy() for c in ("key", "i", "j", "m", "s", "own", "size", "n")}
        self.__dict__.update(num)
        new = np.ones(len(self.text), dtype=bool)
        new[1:] = _changes(num)
        self.tile = np.cumsum(new) - 1
        self.starts = np.append(np.flatnonzero(new), len(new))
        self.found: list[tuple[np.ndarray, np.ndarray]] = []

    def blocks(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows to compare with rows; small tiles share a block."""
        pack: list[int] = []
        longest = 0
        for a, b in zip(self.starts[:-1], self.starts[1:], strict=True):
            size = int(self.size[a:b].max())
            width = max(1, min(BLOCK, CELLS // (size + 1)))
            if b - a > width:
                rows = np.arange(a, b)
                rows = rows[np.argsort(self.own[rows], kind="stable")]
                cut = [rows[k : k + width] for k in range(0, len(rows), width)]
                for x in range(len(cut)):
                    for y in range(x, len(cut)):
                        yield cut[x], cut[y]
                continue
            longest = max(longest, size)
            if len(pack) + b - a > max(1, min(BLOCK, CELLS // (longest + 1))) and pack:
                yield np.array(pack), np.array(pack)
                pack, longest = [], size
            pack.extend(range(a, b))
        if pack:
            yield np.array(pack), np.array(pack)

    def matrix(self, rows: np.ndarray, backwards: bool, pad: int) -> np.ndarray:
        words = [self.text[r] for r in rows]
        if backwards:
            words = [w[::-1] for w in words]
        width = max(int(self.size[rows].max()), 1)
        out = np.array(words, dtype=f"<U{width}").view(np.uint32).reshape(len(rows), width)
        return np.where(np.arange(width) < self.size[rows][:, None], out, np.uint32(pad))

    def common(self, x: np.ndarray, y: np.ndarray, may: np.ndarray, backwards: bool) -> np.ndarray:
        """Length of the common beginning (or end) of each pair."""
        a = self.matrix(x, backwards, 2**32 - 1)
        b = self.matrix(y, backwards, 2**32 - 2)
        alive, length = may.copy(), np.zeros(may.shape, dtype=np.int32)
        for c in range(min(a.shape[1], b.shape[1])):
            alive &= a[:, c, None] == b[None, :, c]
            if not alive.any():
                break
            length += alive
        return length

    def compare(self) -> None:
        for x, y in self.blocks():
            short = self.size == self.m
            may = (self.tile[x][:, None] == self.tile[y]) & (short[x][:, None] | short[y])
            many = self.i[x] != self.j[x]  # in a tile of two blocks only rows of different blocks meet
            if many.any():
                may &= ~many[:, None] | (self.own[x][:, None] != self.own[y])
            if x is y or np.array_equal(x, y):
                may &= np.arange(len(x))[:, None] < np.arange(len(y))
            if not may.any():
                continue
            front, back = self.common(x, y, may, False), self.common(x, y, may, True)
            longer = np.maximum(self.size[x][:, None], self.size[y])
            p, q = np.nonzero(may & (front + back >= longer - 1))
            m, at = self.m[x[p]].astype(np.int64), front[p, q]
            gaps = np.minimum(-(-m // GAP), MOST)
            at = np.minimum(at, m - 1)
            s = self.s[x[p]]
            here = (s * m // gaps <= at) & (at < (s + 1) * m // gaps)
            self.found.append((x[p[here]], y[q[here]]))

    def links(self) -> pa.Table:
        self.compare()
        a = np.concatenate([f[0] for f in self.found] or [np.zeros(0, int)])
        b = np.concatenate([f[1] for f in self.found] or [np.zeros(0, int)])
        one, two = np.concatenate([a, b]), np.concatenate([b, a])
        text = pa.array(self.text, pa.string())
        return pa.table(
            [text.take(pa.array(one)), text.take(pa.array(two)), pa.array(self.n[two], pa.int64())], schema=_LINKS
        )


_LINKS = pa.schema([("word", pa.string()), ("near", pa.string()), ("near_n", pa.int64())])


def _changes(num: dict[str, np.ndarray]) -> np.ndarray:
    return (np.diff(num["key"]) != 0) | (np.diff(num["i"]) != 0) | (np.diff(num["j"]) != 0)


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = None  # rows of the last tile, which may go on in the next batch
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        if held is not None:
            rows = pa.concat_tables([held, rows])
        ends = np.flatnonzero(_changes({c: rows.column(c).to_numpy() for c in ("key", "i", "j")}))
        cut = int(ends[-1]) + 1 if len(ends) else 0
        held = rows.slice(cut).combine_chunks()
        if cut:
            yield from _Words(rows.slice(0, cut)).links().to_batches()
    if held is not None and held.num_rows:
        yield from _Words(held).links().to_batches()


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n) of every two near words, both ways, each once."""
    given = words.where(F.length("word") > 0).groupBy("word").agg(F.sum("n").cast("long").alias("n"))
    return _tiled(_keyed(given)).mapInArrow(_links, "word string, near string, near_n long")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) where forms (word, form) lead, by doubling."""
    state = durable(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = state.select(F.col("word").alias("_from"), F.col("root").alias("_to"))
        if state.join(further, F.col("root") == F.col("_from"), "left_semi").isEmpty():
            return state
        state = durable(
            state.join(further, F.col("root") == F.col("_from"), "left").select(
                "word", F.coalesce("_to", "root").alias("root")
            ),
            "spelling-roots",
        )


def group_variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) per word of (word, n)."""
    words = durable(
        words.where(F.length("word") > 0).groupBy("word").agg(F.sum("n").cast("long").alias("n")), "spelling-words"
    )
    best = (
        near_words(words)
        .groupBy("word")
        .agg(
            F.count("*").alias("n_near"),
            F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"),
        )
    )
    frequent = -F.col("best.less") >= ratio * F.col("n")
    named = durable(
        words.join(best, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(frequent, F.col("best.near")).alias("form"),
            F.when(frequent, -F.col("best.less")).alias("form_n"),
        ),
        "spelling-forms",
    )
    roots = _roots(named.where("form IS NOT NULL"))
    return named.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
