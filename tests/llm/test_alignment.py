from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from peerglass.llm import alignment as AL
from peerglass.llm.queries import QUERIES

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.mark.parametrize("piece", [1, 2, 3, 7, 50, 10_000])
def test_pieces_find_every_shared_end(piece):
    rng = np.random.default_rng(piece)
    for n in (1, 5, 40, 400):
        a = np.unique(np.append(rng.integers(1, 2 * n + 2, n), 2 * n + 2))
        b = np.unique(np.append(rng.integers(1, 2 * n + 2, rng.integers(1, n + 1)), 2 * n + 2))
        i, j = AL.diagonals(a, b, piece)
        assert (np.diff(i) >= 0).all() and (np.diff(j) >= 0).all() and (i[-1], j[-1]) == (len(a), len(b))
        assert (np.diff(i) + np.diff(j) <= piece + 1).all()
        x, y = AL.group_ends(a, b, piece)
        want = [(p + 1, int(np.searchsorted(b, v)) + 1) for p, v in enumerate(a) if v in b]
        assert list(zip(x.tolist(), y.tolist(), strict=True)) == want


def letters():
    """Byte-level letters by their definition, one byte at a time."""
    out, extra = {}, 0
    for byte in range(256):
        if 33 <= byte <= 126 or 161 <= byte <= 172 or byte >= 174:
            out[chr(byte)] = byte
        else:
            out[chr(256 + extra)] = byte
            extra += 1
    return out


def brute(rows):
    tok = Tokenizer.from_file(A)
    tok.encode_special_tokens = True
    sp = SentencePieceProcessor(model_file=B)
    byte = letters()
    docs = []
    for doc, text, *_ in rows:
        groups = []
        if text:
            xs = tok.encode(" " + text, add_special_tokens=False).ids
            ys = sp.encode(text)
            xb = [bytes(byte[c] for c in tok.id_to_token(i)) for i in xs]
            yb = [
                bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()
                for p in map(sp.id_to_piece, ys)
            ]
            if b"".join(xb) == b"".join(yb) == (" " + text).encode():
                xe, ye = np.cumsum([len(x) for x in xb]).tolist(), np.cumsum([len(y) for y in yb]).tolist()
                cuts = sorted(set(xe) & set(ye))
                at = 0
                for end in cuts:
                    groups.append((
                        [i for i, e in zip(xs, xe, strict=True) if at < e <= end],
                        [i for i, e in zip(ys, ye, strict=True) if at < e <= end],
                    ))
                    at = end
        docs.append((doc, groups))
    holds, best = Counter(), defaultdict(int)
    links = [Counter((x, y) for g in groups for x in g[0] for y in g[1]) for _, groups in docs]
    for c in links:
        holds.update(c.keys())
    for (x, _), n in holds.items():
        best[x] = max(best[x], n)
    out = []
    for (doc, groups), c in zip(docs, links, strict=True):
        text = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        out.append((
            doc, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), sum(c.values()),
            sum(n for p, n in c.items() if holds[p] == best[p[0]]), sum(n * holds[p] for p, n in c.items()),
            hashlib.sha256(text.encode()).hexdigest() if groups else "",
        ))
    return sorted(out, key=repr)


ROWS = [
    (1, "The quick brown fox, naïve façade — 東京 and  two  spaces"),
    (2, "The quick brown fox"), (2, "The quick brown fox"), (None, "fox"), (3, None), (4, ""), (5, " "), (6, "\n\n a\t"),
    (7, "<|endoftext|> </s> <s> <unk> <0x41> ▁ lower▁one"), (8, "aaaa" * 300), (9, "\x00\x01 zero"),
    (10, " leading and trailing "), (11, "\U0001f600‍\U0001f525" * 5), (12, " " * 100 + "x"), (13, "　ｆｕｌｌ"),
]


def results(df):
    assert df.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_counts_and_groups_against_brute_force(docs_of):
    assert results(AL.link_counts(docs_of(ROWS).repartition(3), A, B)) == brute(ROWS)


def test_small_pieces_chunks_and_blocks(docs_of, monkeypatch):
    rows = ROWS[:12]
    known = AL.Vocabularies(A, B)
    texts = [r[1] for r in rows]
    whole, cut = AL.align_texts(texts, known), AL.align_texts(texts, known, piece=3)
    assert (whole.a_end == cut.a_end).all() and (whole.b_end == cut.b_end).all()
    pairs = AL.linked_pairs(whole, known.size[1])
    monkeypatch.setattr(AL, "_LINKS", 2)  # every larger group goes by distinct ids
    for x, y in zip(pairs, AL.linked_pairs(whole, known.size[1]), strict=True):
        assert (x == y).all()


def test_long_texts_are_encoded_in_parts(monkeypatch):
    known = AL.Vocabularies(A, B)
    text = " It's 12 o'clock; the   bells don't ring. Ünder\n\nthe bridge 3 4  five" * 30
    want = known.a.encode(text, add_special_tokens=False).ids
    monkeypatch.setattr(AL, "CHUNK_CHARS", 40)
    assert known.encode_a(text) == want


def test_ranks_give_the_library_s_ids():
    known = AL.Vocabularies(A, B)
    rng = np.random.default_rng(3)
    letters_ = [chr(i) for i in range(0x250)] + list(" \n\t'sdmtrvel.,0123") * 20
    texts = ["".join(rng.choice(letters_, rng.integers(1, 40))) for _ in range(3000)]
    texts += [p.format(c) for c in map(chr, range(0x250)) for p in ("{0}", "a{0}b", " {0} ", "{0}{0}{0}", "1{0} {0}'s")]
    texts += [" " * 20_000, "a" * 20_000, " \n" * 20_000]
    for t in texts:
        assert known.fast_a.encode_ordinary(t) == known.a.encode(t, add_special_tokens=False).ids, t


def test_spans(docs_of):
    rows = {r.doc_id: r for r in AL.align(docs_of([(1, "naïve fox"), (2, None), (3, "b")]), A, B).collect()}
    assert rows[2].a_ids == [] and rows[2].groups == []
    known = AL.Vocabularies(A, B)
    for doc, text in ((1, " naïve fox"), (3, " b")):
        r, a, b = rows[doc], 0, 0
        start = 0
        for g in r.groups:
            piece = text.encode()[start : g.byte_end]
            assert b"".join(known.a_bytes[i] for i in r.a_ids[a : g.a_end]) == piece
            assert b"".join(known.b_bytes[i] for i in r.b_ids[b : g.b_end]) == piece
            a, b, start = g.a_end, g.b_end, g.byte_end
        assert (a, b, start) == (len(r.a_ids), len(r.b_ids), len(text.encode()))


def test_empty_table_and_clashing_columns(spark):
    schema = "doc_id long, text string, block string, pair int, counts string"
    assert AL.link_counts(spark.createDataFrame([], schema), A, B).count() == 0
    df = spark.createDataFrame([(1, "two words", "x", 1, "y")], schema)
    assert results(AL.link_counts(df, A, B)) == brute([(1, "two words")])


def test_query_against_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert results(QUERIES["op13_cross_tokenizer_alignment"](spark, sf_dir)) == brute(docs)


def test_stored_rows_are_of_bounded_size(docs_of, monkeypatch):
    known = AL.Vocabularies(A, B)
    monkeypatch.setattr(AL, "PART", 5, raising=False)
    block = AL._Block()
    block.add([r[0] for r in ROWS], [r[1] for r in ROWS], known)
    rows = [r for batch in block.rows(0) for r in batch.to_pylist()]
    assert max(len(r["place"] or b"") for r in rows) == 4 * 5 and max(len(r["pair"] or []) for r in rows) == 5
    assert [r["doc_id"] for r in rows if r["n_a"] is not None] == [r[0] for r in ROWS]
    pairs = [x for r in rows for x in r["pair"] or []]
    assert pairs == sorted(set(pairs))
    # A document's parts add up.
    cut = [r for r in rows if r["doc"] is not None]
    count = np.ones(len(pairs), dtype=np.int64)
    counted = {"at": np.arange(len(pairs)), "n": count, "is_best": count == 1}
    schema = AL._BLOCK
    summed = AL._summed(AL.pa.Table.from_pylist(cut[::-1], schema), AL.pa.table(counted)).to_pylist()
    assert [(r["doc_id"], r["count_sum"], r["n_best"]) for r in summed] == [
        (r["doc_id"], r["n_links"], r["n_links"]) for r in cut if r["n_a"] is not None
    ]
