from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from peerglass.llm.packing import deficit_round_robin, pack, sequence_bounds
from peerglass.llm.tokens import Encoder

PATH = public_tokenizers.path("word_bpe_49k.json")


def corpus(n=300):
    rng = random.Random(1)
    words = ["Haus", "the", "x1.", "don't", "É.", "a,b", "İΣ", "42", "end.", "z…"]
    return [
        (i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 9, 60, 400]))), "en",
         rng.choice(["a", "a", "a", "b", "c", None])) for i in range(n)
    ]


def checked(rows, pieces, window):
    """Every id once, offsets gapless, checksums right; returns sequences by id."""
    library = Tokenizer.from_file(PATH)
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
    for doc, text, *_ in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for p in sorted(by_doc.pop(doc), key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(ids)) and p.length > 0
            at += p.length
            assert p.ids_crc32 == zlib.crc32(ids[p.start : at].tobytes())
        assert at == len(ids)
    assert not by_doc
    sizes = {}
    for s, ps in by_seq.items():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        sizes[s] = at
    assert sorted(sizes) == list(range(len(sizes)))
    assert all(v == window or v & (v - 1) == 0 for v in sizes.values())
    return by_seq, sizes


def test_every_token_once_and_windows_to_proportion(docs_of):
    rows = corpus()
    for lane in (256, 2**19):
        pieces = pack(docs_of(rows), PATH, window=64, lane_tokens=lane).collect()
        by_seq, sizes = checked(rows, pieces, 64)
        held = Counter()
        for p in pieces:
            held[p.source] += p.length
        total = sum(held.values())
        for s, ps in by_seq.items():
            if sizes[s] == 64:
                got = Counter()
                for p in ps:
                    got[p.source] += p.length
                assert all(abs(got[k] - 64 * held[k] / total) < 3 for k in held), (lane, s, got)


def test_targets_until_a_source_runs_out(docs_of):
    rows = corpus()
    pieces = pack(docs_of(rows), PATH, window=64, lane_tokens=512, targets={"b": 0.5, "a": 0.3, "c": 0.2, None: 0.1}).collect()
    by_seq, _ = checked(rows, pieces, 64)
    first = Counter()
    for s in range(8):
        for p in by_seq[s]:
            first[p.source] += p.length
    assert abs(first["b"] / sum(first.values()) - 0.5 / 1.1) < 0.03


def test_edge_cases(docs_of):
    rows = [(1, None, "en", "a"), (2, "", "en", None), (3, "word " * 5000, "en", "a")]
    checked(rows, pack(docs_of(rows), PATH, lane_tokens=1000).collect(), 4096)
    assert pack(docs_of([]), PATH).count() == 0
    twice = pack(docs_of([(1, "a b", "en", "s")] * 2), PATH).collect()
    assert sum(p.length for p in twice) == 6 and {p.doc_tokens for p in twice} == {3}


def test_words_give_the_ids_of_the_whole_text():
    library, fast = Tokenizer.from_file(PATH), Encoder(PATH, by_word=True, most_kept=50)
    texts = [r[1] for r in corpus(60)] + [
        "a.b, c.. d.\ne,\tf. <|endoftext|>. x", "ＫΣİ ſ é. 'S it's.", "1. 2, ²., á., \x1c b\x0b.",
    ]
    rng = random.Random(2)
    signs = [chr(i) for i in range(0x250)] + list(" \n.,'019sTlL") * 30 + ["Σ", "東", "\u0301", "<|endoftext|>", "<|EndOfText|>"]
    texts += ["".join(rng.choices(signs, k=rng.randint(1, 60))) for _ in range(3000)]
    whole = [np.array(library.encode(t, add_special_tokens=False).ids, "<u2").tobytes() for t in texts]
    assert fast.encode_all(pa.array(texts)) == whole
    words = ["".join(rng.choices("etaoinshrdlucmfwypvbgkqjxzéßñøÿ", range(32, 1, -1), k=rng.randint(1, 14))) for _ in range(40_000)]
    assert fast.ranked.encode(words, "<u2") == [fast.whole(w) for w in words]
    for t in texts[:60]:
        assert fast.encode(t) == np.array(library.encode(t, add_special_tokens=False).ids, "<u2").tobytes(), t


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 300), min_size=1, max_size=6), st.integers(1, 50), st.data())
def test_round_robin_takes_everything(have, window, data):
    total = sum(have)
    room = [window] * (total // window) + ([total % window] if total % window else [])
    owed = [data.draw(st.floats(0, 0.99)) for _ in have]
    share = np.array(have) / total
    taken = deficit_round_robin(np.array(have), share, np.array(owed), np.array(room))
    assert taken.sum(axis=0).tolist() == have and taken.sum(axis=1).tolist() == room
    assert taken.min() >= 0
    drift = np.abs(np.cumsum(taken, axis=0) - np.outer(np.cumsum(room), share))
    assert drift.max() <= len(have) + 1


def test_sequence_bounds():
    ids, starts = sequence_bounds(0, 21, 21, 8)
    assert (ids.tolist(), starts.tolist()) == ([0, 1, 2, 3], [0, 8, 16, 20])
    ids, starts = sequence_bounds(9, 18, 21, 8)
    assert (ids.tolist(), starts.tolist()) == ([1, 2], [8, 16])
