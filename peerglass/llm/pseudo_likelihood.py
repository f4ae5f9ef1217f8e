"""Masked pseudo-likelihood of documents under a bidirectional window network.

A document's score is the sum over its characters of log p(character | the two
characters on either side). The network embeds the four neighbours, has one hidden
layer, and a softmax over a closed alphabet (the most frequent lower-case
characters of the corpus, ``hashed`` symbols that all others share by a hash, one
for the text's edges).

It learns from every character of the corpus: the windows of all documents are
counted (``window_counts``), and the counts, not the texts, are dealt to shards of
about ``shard_windows`` distinct windows at most. In each round every shard trains a
copy in numpy on all of its windows, weighted by their counts, and the copies are
averaged. The driver holds a copy of the network per shard, whose size depends on
the alphabet alone.

Texts are scored whole. Windows are looked up once per batch, so the network runs
on distinct windows only.

Defined results: null and empty texts have no tokens, log-likelihood 0 and a null
score; an empty corpus gives an untrained network. Rows that repeat are counted
and scored alike. Counts, draws and averages follow fixed orders and seeds, so
reruns agree up to the last digits of floating-point products; scores are rounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peerglass.sources.tables import durable

EDGE, OTHER = 0, 1
REACH = 2
BITS = 7  # of a symbol in a packed window
_CHUNK = 4_000_000


@dataclass(frozen=True)
class Settings:
    alphabet: int = 96  # symbols, edge and other among them; with ``hashed`` at most 2**BITS
    hashed: int = 32  # symbols of rarer characters
    embedding: int = 12
    hidden: int = 32
    shards: int = 12  # at least
    shard_windows: int = 200_000
    rounds: int = 5
    steps: int = 60  # of a shard in a round, at least
    batch: int = 1024
    rate: float = 0.01
    seed: int = 1


def _chunks(texts: pa.Array) -> Iterator[list[str]]:
    part, size = [], 0
    for text in texts.to_pylist():
        part.append((text or "").lower())
        size += len(part[-1])
        if size >= _CHUNK:
            yield part
            part, size = [], 0
    if part:
        yield part


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype="<u4")


def symbol_counts(documents: DataFrame) -> DataFrame:
    """(code, n): lower-case characters of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0x110000, dtype=np.int64)
        for batch in batches:
            for part in _chunks(batch.column("text")):
                total += np.bincount(_codes("".join(part)), minlength=len(total))
        code = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(total[code])], names=["code", "n"])

    found = documents.select("text").mapInArrow(run, "code long, n long")
    return found.groupBy("code").agg(F.sum("n").alias("n"))


def alphabet_of(documents: DataFrame, size: int, hashed: int = Settings.hashed) -> np.ndarray:
    """Symbol of every code point; the most frequent ones have their own."""
    if size + hashed > 1 << BITS:
        raise ValueError(f"more than {1 << BITS} symbols")
    top = symbol_counts(documents).orderBy(F.desc("n"), "code").limit(size - 2).collect()
    table = np.full(0x110000, OTHER, dtype=np.uint8)
    if hashed:
        mixed = (np.arange(len(table), dtype=np.uint64) * np.uint64(0x9E3779B1)) >> np.uint64(12)
        table[:] = size + mixed % np.uint64(hashed)
    for i, row in enumerate(top):
        table[row["code"]] = i + 2
    return table


def _windows(part: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed windows of all characters, and where each text ends among them."""
    edge = "\x00" * REACH  # replaced below, also where a text has this character itself
    sizes = np.array([len(t) for t in part], dtype=np.int64)
    symbols = table[_codes(edge + edge.join(part) + edge)].astype(np.int64)
    inside = np.ones(len(symbols), dtype=bool)
    gaps = np.concatenate([[0], np.cumsum(sizes + REACH)])
    for i in range(REACH):
        inside[gaps + i] = False
    symbols[~inside] = EDGE
    n = len(symbols) - 2 * REACH
    packed = np.zeros(n, dtype=np.int64)
    for i in range(2 * REACH + 1):
        packed = (packed << BITS) | symbols[i : i + n]
    return packed[inside[REACH : REACH + n]], np.cumsum(sizes)


def window_counts(documents: DataFrame, table: np.ndarray) -> DataFrame:
    """(window, n) over all characters of all texts."""
    sent = documents.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(windows: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(windows), pa.array(n)], names=["window", "n"])

        held = pd.Series(dtype=np.int64)
        for batch in batches:
            for part in _chunks(batch.column("text")):
                at, windows = pd.factorize(_windows(part, sent.value)[0])
                new = pd.Series(np.bincount(at, minlength=len(windows)), index=windows)
                held = held.add(new, fill_value=0).astype(np.int64) if len(held) else new
                if len(held) > 4_000_000:
                    yield out(held.index.to_numpy(np.int64), held.to_numpy(np.int64))
                    held = held.iloc[:0]
        if len(held):
            yield out(held.index.to_numpy(np.int64), held.to_numpy(np.int64))

    found = documents.select("text").mapInArrow(run, "window long, n long")
    return found.groupBy("window").agg(F.sum("n").alias("n"))


class Network:
    """Embeddings of the four neighbours -> tanh layer -> softmax over the alphabet."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.weights = weights

    @classmethod
    def fresh(cls, s: Settings) -> Network:
        rng = np.random.default_rng(s.seed)
        wide, symbols = 2 * REACH * s.embedding, s.alphabet + s.hashed
        return cls(
            {
                "embed": rng.normal(0, 0.3, (2 * REACH, symbols, s.embedding)),
                "inner": rng.normal(0, wide**-0.5, (wide, s.hidden)),
                "inner_bias": np.zeros(s.hidden),
                "outer": rng.normal(0, s.hidden**-0.5, (s.hidden, symbols)),
                "outer_bias": np.zeros(symbols),
            }
        )

    def _forward(self, windows: np.ndarray):
        w, mask = self.weights, (1 << BITS) - 1
        symbols = [(windows >> (BITS * (2 * REACH - i))) & mask for i in range(2 * REACH + 1)]
        target = symbols.pop(REACH)
        x = np.concatenate([w["embed"][i][s] for i, s in enumerate(symbols)], axis=1)
        h = np.tanh(x @ w["inner"] + w["inner_bias"])
        z = h @ w["outer"] + w["outer_bias"]
        z -= z.max(axis=1, keepdims=True)
        log_p = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
        return symbols, target, x, h, log_p

    def log_p(self, windows: np.ndarray) -> np.ndarray:
        out = [np.zeros(0)]
        for at in range(0, len(windows), 8192):
            _, target, _, _, log_p = self._forward(windows[at : at + 8192])
            out.append(log_p[np.arange(len(target)), target])
        return np.concatenate(out)

    def gradients(self, windows: np.ndarray, weight: np.ndarray | None = None) -> dict[str, np.ndarray]:
        """Of the sum of -log p times ``weight``, by default of the mean."""
        symbols, target, x, h, log_p = self._forward(windows)
        w, n = self.weights, len(windows)
        dz = np.exp(log_p)
        dz[np.arange(n), target] -= 1
        dz *= 1 / n if weight is None else weight[:, None]
        dh = (dz @ w["outer"].T) * (1 - h * h)
        dx = dh @ w["inner"].T
        embed = np.zeros_like(w["embed"])
        size = w["embed"].shape[2]
        for i, s in enumerate(symbols):
            np.add.at(embed[i], s, dx[:, i * size : (i + 1) * size])
        return {
            "embed": embed, "inner": x.T @ dh, "inner_bias": dh.sum(axis=0),
            "outer": h.T @ dz, "outer_bias": dz.sum(axis=0),
        }

    def train(self, windows: np.ndarray, counts: np.ndarray, s: Settings, seed: list[int]) -> int:
        """Adam steps over all windows, weighted by their counts; returns windows passed.

        Windows are dealt to batches in random order, again until there were
        ``steps`` steps. The most frequent ones are in every batch with a share of
        their count, so that batches weigh about the same.
        """
        rng = np.random.default_rng(seed)
        often = np.argsort(-counts, kind="stable")[: s.batch // 4]
        rest = np.setdiff1d(np.arange(len(windows)), often)
        batches = max(1, -(-len(rest) // (s.batch - len(often))))
        share = counts * (batches / counts.sum())
        slope = {k: np.zeros_like(v) for k, v in self.weights.items()}
        power = {k: np.zeros_like(v) for k, v in self.weights.items()}
        t = passed = 0
        while t < s.steps:
            for part in np.array_split(rng.permutation(rest), batches):
                t += 1
                passed += len(part)
                drawn = np.concatenate([often, part])
                weight = np.concatenate([share[often] / batches, share[part]])
                for k, g in self.gradients(windows[drawn], weight).items():
                    slope[k] += 0.1 * (g - slope[k])
                    power[k] += 0.001 * (g * g - power[k])
                    step = slope[k] / (1 - 0.9**t) / (np.sqrt(power[k] / (1 - 0.999**t)) + 1e-8)
                    self.weights[k] = self.weights[k] - s.rate * step
            passed += len(often)
        return passed

    def packed(self) -> bytes:
        return b"".join(self.weights[k].tobytes() for k in sorted(self.weights))

    def unpacked(self, data: bytes) -> Network:
        """A network of the same shape from ``packed`` weights."""
        flat, at, out = np.frombuffer(data), 0, {}
        for k in sorted(self.weights):
            n = self.weights[k].size
            out[k] = flat[at : at + n].reshape(self.weights[k].shape).copy()
            at += n
        return Network(out)


def _one_round(start: Network, r: int, s: Settings):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("window")
        shard, n = key[0].as_py(), table.column("n").to_numpy()
        copy = start.unpacked(start.packed())
        copy.train(table.column("window").to_numpy(), n, s, [s.seed, r, shard])
        return pa.table({"shard": [shard], "n": [int(n.sum())], "weights": [copy.packed()]})

    return run


def train(counts: DataFrame, s: Settings) -> Network:
    """Rounds of training on all shards of a stored table of window counts."""
    stored = durable(counts, "lm-windows")
    n_shards = max(s.shards, -(-stored.count() // s.shard_windows))
    shards = stored.withColumn("shard", F.pmod(F.xxhash64("window"), F.lit(n_shards)))
    net = Network.fresh(s)
    for r in range(s.rounds):
        made = shards.groupBy("shard").applyInArrow(
            _one_round(net, r, s), "shard long, n long, weights binary"
        )
        copies = sorted(made.collect(), key=lambda row: row["shard"])  # one row per shard
        if not copies:
            return net
        total = sum(row["n"] for row in copies)
        mean = {k: np.zeros_like(v) for k, v in net.weights.items()}
        for row in copies:
            for k, v in net.unpacked(bytes(row["weights"])).weights.items():
                mean[k] += v * (row["n"] / total)
        net = Network(mean)
    return net


_SCORES = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("log_likelihood", pa.float64()),
        ("score", pa.float64()),
    ]
)


def score(documents: DataFrame, table: np.ndarray, net: Network, most_kept: int = 2_000_000) -> DataFrame:
    """(doc_id, n_tokens, log_likelihood, score): score is the mean per token."""
    sent = documents.sparkSession.sparkContext.broadcast((table, net))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols, network = sent.value
        known, value = np.zeros(0, np.int64), np.zeros(0)  # windows met before, sorted
        for batch in batches:
            ids, at_row = batch.column("doc_id"), 0
            for part in _chunks(batch.column("text")):
                windows, ends = _windows(part, symbols)
                at, distinct = pd.factorize(windows)
                place = np.searchsorted(known, distinct)
                met = np.zeros(len(distinct), dtype=bool)
                inside = place < len(known)
                met[inside] = known[place[inside]] == distinct[inside]
                log_p = np.empty(len(distinct))
                log_p[met] = value[place[met]]
                log_p[~met] = network.log_p(distinct[~met])
                if len(known) + (~met).sum() <= most_kept:
                    known = np.concatenate([known, distinct[~met]])
                    value = np.concatenate([value, log_p[~met]])
                    order = np.argsort(known, kind="stable")
                    known, value = known[order], value[order]
                sums = np.concatenate([[0.0], np.cumsum(log_p[at])])[np.concatenate([[0], ends])]
                total, n = np.diff(sums), np.diff(np.concatenate([[0], ends]))
                mean = [round(t / k, 6) if k else None for t, k in zip(total, n, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(at_row, len(part)),
                        pa.array(n),
                        pa.array(np.round(total, 3)),
                        pa.array(mean, pa.float64()),
                    ],
                    schema=_SCORES,
                )
                at_row += len(part)

    return documents.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_tokens long, log_likelihood double, score double"
    )


def score_documents(
    documents: DataFrame,
    settings: Settings | None = None,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Learns from all texts, then scores all texts."""
    s = settings or Settings()
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    table = alphabet_of(docs, s.alphabet, s.hashed)
    return score(docs, table, train(window_counts(docs, table), s))
