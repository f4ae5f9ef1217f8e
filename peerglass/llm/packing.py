"""Mixture-controlled packing by deficit round-robin.

Every source is a queue of documents in a fixed pseudo-random order. Each window
of ``window`` tokens credits every source with its share of the window; a source
gives as many tokens as its credit allows, what it could not give or gave too much
stays as its deficit for the next windows, and the tokens still missing come from
the sources with the largest deficits. Documents are cut where a window ends.

The queues are cut into lanes of about ``lane_tokens`` tokens at equal virtual
times: lane l of a source with share p holds its tokens from floor(p * l * lane)
on. So lanes can be packed side by side: where a lane starts, and what each source
is owed there, follow from l alone. Windows run on across lanes.

Without targets a source's share is what it holds of all tokens, which makes every
window, to the last, a picture of the corpus. With targets, sources run out at
different times and the others share the windows from then on. All tokens are
packed, each once, without padding: windows are full, and what is left at the end
goes to sequences whose lengths are powers of two.

Defined results: null text is empty, that is, the end token only; a null source is
a source of its own; sources without a positive target get the share they hold;
rows that repeat an id are separate documents; an empty table gives an empty
result. Further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peerglass.llm.prefix import join_same, running_totals
from peerglass.llm.tokens import Encoder
from peerglass.sources.tables import durable


@lru_cache(maxsize=2)
def _encoder(path: str, by_word: bool) -> Encoder:
    return Encoder(path, by_word)  # one per Python worker, so that words stay known


def tokenised(
    documents: DataFrame, path: str, end_id: int, *, by_word: bool, id_col: str, text_col: str,
    source_col: str,
) -> DataFrame:
    """(row, doc_id, source, n, ids): ids with the end token, as bytes; stored."""
    docs = documents.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    schema = pa.schema(
        [("doc_id", pa.int64()), ("source", pa.string()), ("n", pa.int64()), ("ids", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, by_word)
        end = encoder.packed([end_id])
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                ids = [i + end for i in encoder.encode_all(part.column("text"))]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("source"),
                        pa.array([len(i) // encoder.width for i in ids], pa.int64()),
                        pa.array(ids, pa.binary()),
                    ],
                    schema=schema,
                )

    return durable(
        docs.mapInArrow(run, "doc_id long, source string, n long, ids binary").withColumn(
            "row", F.monotonically_increasing_id()
        ),
        "pack-tokens",
        compression="zstd",
    )


def sequence_bounds(begin: int, end: int, total: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and first tokens of the sequences that meet tokens [begin, end) of ``total``.

    Full windows, then the binary digits of the rest, largest first.
    """
    full = total // window
    first, last = begin // window, min((end - 1) // window + 1, full)
    ids = list(range(first, last))
    starts = [i * window for i in ids]
    at, i = full * window, full
    for bit in range(window.bit_length(), -1, -1):
        size = 1 << bit
        if (total - full * window) & size:
            if at < end and at + size > begin:
                ids.append(i)
                starts.append(at)
            at, i = at + size, i + 1
    return np.array(ids, dtype=np.int64), np.array(starts, dtype=np.int64)


def deficit_round_robin(
    have: np.ndarray, share: np.ndarray, owed: np.ndarray, room: np.ndarray
) -> np.ndarray:
    """Tokens that each window (row) takes from each source (column).

    ``have``: tokens per source; ``owed``: deficits at the start; ``room``: window
    sizes, which add up to all tokens.
    """
    left, deficit = have.copy(), owed.astype(float).copy()
    taken = np.zeros((len(room), len(have)), dtype=np.int64)
    for w, size in enumerate(room):
        active = left > 0
        weight = np.where(active, share, 0.0)
        deficit = np.where(active, deficit + size * weight / weight.sum(), 0.0)
        take = np.clip(np.floor(deficit), 0, left).astype(np.int64)
        short = int(size - take.sum())
        while short > 0:  # the largest deficits first
            can = np.flatnonzero(take < left)
            order = can[np.argsort(-(deficit - take)[can], kind="stable")]
            each = max(short // len(order), 1)
            for s in order:
                more = min(each, int(left[s] - take[s]), short)
                take[s] += more
                short -= more
                if not short:
                    break
        while short < 0:  # the largest overdrafts first
            can = np.flatnonzero(take > 0)
            for s in can[np.argsort((deficit - take)[can], kind="stable")][:-short]:
                take[s] -= 1
                short += 1
        deficit -= take
        left -= take
        taken[w] = take
    return taken


_PIECES = "row long, start long, length long, sequence_id long, offset long"


def _pack_lane(total: int, window: int):
    """Pieces of one lane: window and document edges cut its queues."""

    def run(key: tuple, slices: pa.Table) -> pa.Table:
        slices = slices.sort_by([("source", "ascending"), ("place", "ascending")])
        column = {
            c: slices.column(c).to_numpy()
            for c in ("row", "start", "length", "lane_start", "share", "owed")
        }
        named = slices.column("source").combine_chunks()
        of = named.dictionary_encode(null_encoding="encode").indices.to_numpy()
        n = int(of.max()) + 1
        begins = np.searchsorted(of, np.arange(n))
        have = np.bincount(of, weights=column["length"], minlength=n).astype(np.int64)
        begin = int(column["lane_start"][0])
        ids, starts = sequence_bounds(begin, begin + int(have.sum()), total, window)
        edges = np.append(np.maximum(starts, begin), begin + have.sum())
        taken = deficit_round_robin(
            have, column["share"][begins], column["owed"][begins], np.diff(edges)
        )
        before = np.cumsum(taken, axis=1) - taken  # within the window, sources in order
        out = []
        for s in range(n):
            rows = slice(begins[s], begins[s + 1] if s + 1 < n else None)
            doc_edges = np.concatenate([[0], np.cumsum(column["length"][rows])])
            win_edges = np.concatenate([[0], np.cumsum(taken[:, s])])
            cuts = np.union1d(doc_edges, win_edges)
            at, size = cuts[:-1], np.diff(cuts)
            d = np.searchsorted(doc_edges, at, side="right") - 1
            w = np.searchsorted(win_edges, at, side="right") - 1
            out.append(
                (
                    column["row"][rows][d],
                    column["start"][rows][d] + at - doc_edges[d],
                    size,
                    ids[w],
                    edges[w] - starts[w] + before[w, s] + at - win_edges[w],
                )
            )
        names = ("row", "start", "length", "sequence_id", "offset")
        return pa.table(
            {c: np.concatenate([o[i] for o in out]).astype(np.int64) for i, c in enumerate(names)}
        )

    return run


def _lane_starts(lanes: DataFrame, fan: int = 1024) -> DataFrame:
    """(lane, lane_start): tokens in all earlier lanes, by sums of sums."""
    lanes = lanes.withColumn("up", F.floor(F.col("lane") / fan))
    earlier = (Window.unboundedPreceding, -1)
    ups = lanes.groupBy("up").agg(F.sum("tokens").alias("t"))
    ups = ups.select(
        "up",
        F.coalesce(F.sum("t").over(Window.orderBy("up").rowsBetween(*earlier)), F.lit(0)).alias("base"),
    )
    inside = Window.partitionBy("up").orderBy("lane").rowsBetween(*earlier)
    return lanes.join(ups, "up").select(
        "lane", (F.col("base") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))).alias("lane_start")
    )


def pack(
    documents: DataFrame,
    vocabulary: str,
    *,
    end_id: int = 2,
    window: int = 4096,
    targets: Mapping[str | None, float] | None = None,
    lane_tokens: int = 2**19,
    by_word: bool = True,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source.

    ``by_word``: see ``tokens.Encoder``.
    """
    spark = documents.sparkSession
    tokens = tokenised(
        documents, vocabulary, end_id, by_word=by_word,
        id_col=id_col, text_col=text_col, source_col=source_col,
    )
    held = tokens.groupBy("source").agg(F.sum("n").alias("tokens"))
    everything = Window.partitionBy()
    share = F.col("tokens") / F.sum("tokens").over(everything)
    held = held.withColumn("share", share)
    if targets:
        wanted = spark.createDataFrame(
            [(s, float(w)) for s, w in targets.items() if w > 0], "source string, wanted double"
        )
        held = join_same(held, wanted, ["source"], "left").withColumn(
            "share", F.coalesce("wanted", "share")
        )
        held = held.withColumn("share", F.col("share") / F.sum("share").over(everything))
    held = durable(
        held.select("source", "tokens", "share"), "pack-shares"
    )
    total = held.agg(F.sum("tokens")).first()[0] or 0

    queued = running_totals(
        tokens.select("row", "source", "n", F.xxhash64("doc_id").alias("mixed")),
        ["source"], ["mixed", "row"], "n", "pack-queues",
    )
    rate = F.col("share") * lane_tokens
    cut = lambda lane: F.floor(rate * lane)  # noqa: E731  tokens of the source before a lane
    end = F.col("before") + F.col("n")
    near = F.sequence(
        F.greatest(F.floor(F.col("before") / rate) - 1, F.lit(0)), F.floor(end / rate) + 1
    )
    slices = (
        join_same(queued, held, ["source"])
        .withColumn("lane", F.explode(near))
        .withColumn("place", F.greatest("before", cut(F.col("lane"))))
        .withColumn("length", F.least(end, cut(F.col("lane") + 1)) - F.col("place"))
        .where("length > 0")
        .select(
            "lane", "source", "row", "place", "length", "share",
            (F.col("place") - F.col("before")).alias("start"),
            (rate * F.col("lane") - cut(F.col("lane"))).alias("owed"),
        )
    )
    slices = durable(slices, "pack-slices")
    starts = _lane_starts(slices.groupBy("lane").agg(F.sum("length").alias("tokens")))
    pieces = (
        slices.join(starts, "lane").groupBy("lane").applyInArrow(_pack_lane(total, window), _PIECES)
    )
    of_doc = pieces.groupBy("row").agg(
        F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("pieces")
    )
    return _checked(tokens.join(of_doc, "row"), vocabulary, by_word)


_OUT = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
    "offset long, source string"
)


def _checked(docs: DataFrame, vocabulary: str, by_word: bool) -> DataFrame:
    """A row per piece with the checksum of its ids as 32-bit numbers."""
    names = [c.split()[0] for c in _OUT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = _encoder(vocabulary, by_word).width
        for batch in batches:
            out = {c: [] for c in names}
            for doc_id, source, n, ids, pieces in zip(
                *(batch.column(c).to_pylist() for c in ("doc_id", "source", "n", "ids", "pieces")),
                strict=True,
            ):
                wide = memoryview(np.frombuffer(ids, dtype=f"<u{width}").astype("<u4").tobytes())
                for p in pieces:
                    a, b = p["start"], p["start"] + p["length"]
                    row = (
                        doc_id, a, b - a, zlib.crc32(wide[4 * a : 4 * b]), n,
                        p["sequence_id"], p["offset"], source,
                    )
                    for c, v in zip(names, row, strict=True):
                        out[c].append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[c], pa.string() if c == "source" else pa.int64()) for c in names],
                names=names,
            )

    return docs.select("doc_id", "source", "n", "ids", "pieces").mapInArrow(run, _OUT)
