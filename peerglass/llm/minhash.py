"""Near-duplicates by min-max hashing.

A document is the set of its word shingles. Under each of ``bands * rows / 2``
hash functions both the least and the greatest hash of the set are kept, which
gives ``bands * rows`` signature values for half the evaluations. Documents that
agree on all values of a band share a bucket; with the default of 40 bands of 4
values, two documents of similarity 0.8 miss every bucket with a chance of 7e-10.

Documents with the same set are one class from the start, so exact copies cost
nothing further, however many. Classes that buckets connect form a group. Each
group is compared, on the full sets, with its lead, the class with most bucket
mates; those found alike are one component. Classes that stay outside are then
compared with all others of their group, block by block, as products of their sets
within tasks (see ``_across``), so no link inside a group is lost and no pairs are
written out. Every join is of tables that grow with the documents, and the planner
sees neither how well their files pack nor what ``explode`` makes of them; so they are
merged, and none goes through the driver as a broadcast.

Defined results: words are runs of anything but ASCII white space, with A-Z
lower-cased; a text with fewer words than a shingle is one shingle; null text and
text without words have the empty set and are linked with nothing. Repeated rows
are documents with equal sets. An empty table gives an empty result. Rows with a
null id are compared like others; their component may have no id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peerglass.llm.components import roots
from peerglass.sources.tables import durable

_CHUNK = 4_000_000  # characters whose words are looked up together


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingle_sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    begin = 0
    ends = np.cumsum(lengths)
    while begin < len(texts):
        base = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, base + _CHUNK, side="right")))
        part = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts[begin:end], "")))
        begin = end
        flat = pc.list_flatten(part)
        of = np.repeat(
            np.arange(len(part)), pc.list_value_length(part).to_numpy(zero_copy_only=False)
        )
        there = pc.greater(pc.binary_length(flat), 0)
        of, flat = of[there.to_numpy(zero_copy_only=False)], flat.filter(there)
        coded = flat.dictionary_encode()
        known = np.array(
            [xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()], dtype=np.uint64
        )
        hashes = known[coded.indices.to_numpy()] if len(flat) else np.zeros(0, np.uint64)
        starts = np.searchsorted(of, np.arange(len(part) + 1))
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            yield _shingles(hashes[a:b], words)


def _shingles(hashes: np.ndarray, words: int) -> np.ndarray:
    width = min(words, len(hashes))
    if width == 0:
        return hashes
    h = np.full(len(hashes) - width + 1, width, dtype=np.uint64)
    for i in range(width):
        h = _mixed(h + hashes[i : i + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
    return np.unique(h)


class MinMax:
    """Band values from the least and greatest hashes under seeded permutations."""

    def __init__(self, bands: int, rows: int, seed: int):
        if rows % 2:
            raise ValueError("a band holds least and greatest hashes in equal number")
        rng = np.random.default_rng(seed)
        n = bands * rows // 2
        self.bands, self.rows = bands, rows
        self.turn = rng.integers(0, 2**63, n, dtype=np.uint64)[:, None]
        self.by = (rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1))[:, None]

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        """Per permutation the least and the greatest hash, side by side."""
        low = high = None
        for at in range(0, len(shingles), 2048):
            h = (shingles[None, at : at + 2048] ^ self.turn) * self.by
            a, b = h.min(axis=1), h.max(axis=1)
            low = a if low is None else np.minimum(low, a)
            high = b if high is None else np.maximum(high, b)
        return np.stack([low, high], axis=1).ravel()

    def buckets(self, shingles: np.ndarray) -> np.ndarray:
        values = self.signature(shingles).reshape(self.bands, self.rows)
        h = np.arange(self.bands, dtype=np.uint64)
        for i in range(self.rows):
            h = _mixed(h * np.uint64(0x9E3779B97F4A7C15) + values[:, i])
        return h.view(np.int64)


_SIGNED = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_shingles", pa.int64()),
        ("content", pa.binary()),
        ("buckets", pa.list_(pa.int64())),
    ]
)
_SETS = pa.schema([("content", pa.binary()), ("shingles", pa.list_(pa.int64()))])


def _content(shingles: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None


def _signed(documents: DataFrame, words: int, hashing: MinMax) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(batch.column("text"), words))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_content(s) for s in sets], pa.binary()),
                    pa.array(
                        [hashing.buckets(s) if len(s) else None for s in sets],
                        pa.list_(pa.int64()),
                    ),
                ],
                schema=_SIGNED,
            )

    return documents.mapInArrow(
        run, "doc_id long, n_shingles long, content binary, buckets array<long>"
    )


def _sets(documents: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                sets = list(shingle_sets(batch.column("text")[at : at + 256], words))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([_content(s) for s in sets], pa.binary()),
                        pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
                    ],
                    schema=_SETS,
                )

    return documents.select("text").mapInArrow(run, "content binary, shingles array<long>")


def near_duplicates(
    documents: DataFrame,
    *,
    words: int = 5,
    threshold: int = 80,
    bands: int = 40,
    rows: int = 4,
    seed: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per document.

    Two documents are linked if ``100 * |intersection| >= threshold * |union|``;
    ``component_id`` is the least id that links lead to, ``kept`` whether it is the
    document's own.
    """
    docs = documents.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")
    )
    signed = durable(_signed(docs, words, MinMax(bands, rows, seed)), "minhash-signatures")
    classes = durable(
        signed.where(F.col("content").isNotNull())
        .groupBy("content")
        .agg(
            F.min("doc_id").alias("first"),
            F.first("n_shingles").alias("n"),
            F.first("buckets").alias("buckets"),
        )
        .withColumn("node", F.monotonically_increasing_id()),
        "minhash-classes",
    )
    cells = classes.select(F.explode("buckets").alias("bucket"), "node", "n")
    shared = (
        cells.groupBy("bucket")
        .agg(F.min("node").alias("lead"), F.max("node").alias("most"), F.count("*").alias("size"))
        .where("lead < most")
        .select(F.col("bucket").alias("_bucket"), "lead", "size")
    )
    members = durable(
        cells.join(shared.hint("merge"), F.col("bucket") == F.col("_bucket")).drop("_bucket"), "minhash-members"
    )
    labels = None
    if not members.isEmpty():
        labels = _join_alike(docs, classes, members, words, threshold)
    if labels is None:
        known = classes.withColumn("root", F.col("node"))
    else:
        known = classes.join(labels.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    known = known.select("content", "first", "root")
    least = known.groupBy("root").agg(F.min("first").alias("component_id"))
    named = known.join(least.hint("merge"), "root").select(F.col("content").alias("_content"), "component_id")
    placed = signed.join(named.hint("merge"), F.col("content") == F.col("_content"), "left")
    component = F.when(F.col("content").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return placed.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def _relabelled(labels: DataFrame | None, edges: DataFrame) -> DataFrame | None:
    """Labels (node, root) after further edges (a, b) between nodes."""
    if labels is not None:
        for end in ("a", "b"):
            look = labels.select(F.col("node").alias("_n"), F.col("root").alias("_r")).hint("merge")
            edges = (
                edges.join(look, F.col(end) == F.col("_n"), "left")
                .withColumn(end, F.coalesce("_r", end))
                .drop("_n", "_r")
            )
    edges = durable(edges.where("a != b").distinct(), "minhash-alike")
    if edges.isEmpty():
        return labels
    new = roots(edges)
    if labels is None:
        return new
    look = new.select(F.col("node").alias("_n"), F.col("root").alias("_r")).hint("merge")
    return durable(
        labels.join(look, F.col("root") == F.col("_n"), "left")
        .select("node", F.coalesce("_r", "root").alias("root"))
        .unionByName(new.join(labels.hint("merge"), "node", "left_anti")),
        "minhash-labels",
    )


def _join_alike(
    docs: DataFrame, classes: DataFrame, members: DataFrame, words: int, threshold: int
) -> DataFrame | None:
    """(node, root) of the classes that links join to a lesser one; None if there are none."""
    wanted = members.select("node").distinct().join(
        classes.select("node", "first", "content").hint("merge"), "node"
    )
    # Ids may repeat, so the content decides which text is meant.
    texts = docs.join(
        wanted.select(F.col("first").alias("_first")).distinct().hint("merge"),
        F.col("doc_id").eqNullSafe(F.col("_first")),
        "left_semi",
    )
    sets = durable(
        _sets(texts, words)
        .join(wanted.select("node", "content").hint("merge"), "content")
        .dropDuplicates(["content"])
        .select("node", "shingles"),
        "minhash-sets",
    )
    blobs = roots(
        members.where("node != lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()
    )
    groups = durable(
        members.groupBy("node")
        .agg(F.first("n").alias("n"), F.sum("size").alias("weight"))
        .join(blobs.hint("merge"), "node", "left")
        .select(F.coalesce("root", "node").alias("group"), "node", "n", "weight"),
        "minhash-groups",
    )
    leads = groups.groupBy("group").agg(F.max(F.struct("weight", "node")).alias("lead"))
    of = lambda c: sets.select(F.col("node").alias(c), F.col("shingles").alias(f"_{c}"))
    both = F.size(F.array_intersect("_node", "_lead")).cast("long")
    pairs = groups.join(
        leads.select("group", F.col("lead.node").alias("lead")).hint("merge"), "group"
    ).where("node != lead")
    stars = (
        pairs.join(of("node").hint("merge"), "node")
        .join(of("lead").hint("merge"), "lead")
        .where(100 * both >= threshold * (F.size("_node") + F.size("_lead") - both))
        .select(F.col("lead").alias("a"), F.col("node").alias("b"))
    )
    labels = _relabelled(None, stars)
    return _relabelled(labels, _across(groups, labels, sets, threshold))


def _across(
    groups: DataFrame, labels: DataFrame | None, sets: DataFrame, threshold: int
) -> DataFrame:
    """Links (a, b) between the components that a group falls into.

    Classes outside the component of most bucket mates ("loose") are dealt to
    blocks of bounded size, and so are the others of their group. Every two blocks
    of which one is loose meet in a tile, which is one product of their sets and
    gives no more links than it has classes.
    """
    root = F.col("node")
    if labels is not None:
        groups = groups.join(labels.hint("merge"), "node", "left")
        root = F.coalesce("root", "node")
    groups = groups.withColumn("root", root)
    main = (
        groups.groupBy("group", "root")
        .agg(F.sum("weight").alias("weight"), F.count("*").alias("size"), F.sum("n").alias("held"))
        .groupBy("group")
        .agg(
            F.max(F.struct("weight", "root", "size", "held")).alias("main"),
            F.sum("size").alias("size"), F.sum("held").alias("held"),
        )
        .where("size > main.size AND size > 2")
        .select(
            "group", F.col("main.root").alias("main"),
            _blocks(F.col("size") - F.col("main.size"), F.col("held") - F.col("main.held")).alias("loose_blocks"),
            _blocks(F.col("main.size"), F.col("main.held")).alias("main_blocks"),
        )
    )
    every = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    dealt = groups.join(main.hint("merge"), "group").withColumn("loose", F.col("root") != F.col("main"))
    own = F.pmod(F.xxhash64("node"), F.when(F.col("loose"), F.col("loose_blocks")).otherwise(F.col("main_blocks")))
    dealt = durable(dealt.withColumn("own", own), "minhash-dealt")
    tile = lambda kind, i, j: F.struct(
        F.lit(kind).alias("kind"), i.cast("long").alias("i"), j.cast("long").alias("j")
    )
    ours = F.col("own")
    tiles = F.when(
        F.col("loose"),
        F.concat(
            F.transform(every("loose_blocks"), lambda j: tile("loose", F.least(ours, j), F.greatest(ours, j))),
            F.transform(every("main_blocks"), lambda j: tile("main", ours, j)),
        ),
    ).otherwise(F.transform(every("loose_blocks"), lambda i: tile("main", i, ours)))
    met = (
        dealt.select("group", "node", "root", "loose", F.explode(tiles).alias("tile"))
        .join(sets.hint("merge"), "node")
        .select("group", "tile.*", "node", "root", "loose", "shingles")
    )
    return met.groupBy("group", "kind", "i", "j").applyInArrow(
        _linked(threshold), "a long, b long"
    )


def _blocks(size, held, classes: int = 256, shingles: int = 2**19):
    return F.greatest(F.ceil(size / classes), F.ceil(held / shingles), F.lit(1)).cast("long")


def _linked(threshold: int, columns: int = 4096):
    def run(tile: pa.Table) -> pa.Table:
        node, root = tile.column("node").to_numpy(), tile.column("root").to_numpy()
        sets = tile.column("shingles").combine_chunks()
        size = pc.list_value_length(sets).to_numpy().astype(np.int64)
        of = np.repeat(np.arange(len(node)), size)
        shingle, place, count = np.unique(
            pc.list_flatten(sets).to_numpy(), return_inverse=True, return_counts=True
        )
        both = np.zeros((len(node), len(node)), dtype=np.float32)
        shared = count[place] > 1
        of, place = of[shared], place[shared]
        order = np.argsort(place, kind="stable")
        of, place = of[order], place[order]
        for at in range(0, len(shingle), columns):
            a, b = np.searchsorted(place, (at, at + columns))
            if a < b:
                has = np.zeros((len(node), columns), dtype=np.float32)
                has[of[a:b], place[a:b] - at] = 1
                both += has @ has.T
        union = size[:, None] + size[None, :] - both
        alike = (100 * both >= threshold * union) & (root[:, None] != root[None, :])
        return pa.table(_forest(node, root, *np.nonzero(np.triu(alike))))

    return run


def _forest(node: np.ndarray, root: np.ndarray, left: np.ndarray, right: np.ndarray) -> dict:
    """Links enough to join the components that the given links join."""
    top = {int(r): int(r) for r in np.unique(root)}

    def find(x: int) -> int:
        while top[x] != x:
            top[x] = x = top[top[x]]
        return x

    out: dict[str, list[int]] = {"a": [], "b": []}
    for i, j in zip(left, right, strict=True):
        x, y = find(int(root[i])), find(int(root[j]))
        if x != y:
            top[max(x, y)] = min(x, y)
            out["a"].append(int(node[i]))
            out["b"].append(int(node[j]))
    return {k: pa.array(v, pa.int64()) for k, v in out.items()}
