"""Token ids of whole texts from a given vocabulary file of the tokenizers library."""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from tokenizers import Tokenizer

_WORD = re.compile("[a-zß-öø-ÿ]+")
_SIGNED = re.compile(r"([a-zß-öø-ÿ]+)([!-&(-/:-@\[-`{-~]+)")  # but for apostrophes, which may begin an ending
_CHUNK = 4_000_000  # characters whose words are looked up together


class Encoder:
    """Ids as little-endian bytes, ``width`` bytes each.

    ``by_word`` may be set for vocabularies that lower-case, drop white space and
    never join signs with letters: words are then encoded once and kept (up to
    ``most_kept``), which changes the time and not the ids. Texts for which pieces
    could differ from the whole are encoded whole.
    """

    def __init__(self, path: str, by_word: bool = False, most_kept: int = 600_000):
        self.library = Tokenizer.from_file(path)
        size = self.library.get_vocab_size(with_added_tokens=True)
        self.width = 2 if size <= 2**16 else 4
        self.by_word, self.most_kept = by_word, most_kept
        self.kept: dict[str, bytes] = _Kept(self)
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        added, model = file.get("added_tokens", []), file["model"]
        self.special = [t["content"] for t in added]
        self.ranked = _Ranked(model) if by_word and model.get("end_of_word_suffix") else None

    def packed(self, ids: list[int]) -> bytes:
        return np.array(ids, dtype=f"<u{self.width}").tobytes()

    def whole(self, text: str) -> bytes:
        return self.packed(self.library.encode(text, add_special_tokens=False).ids)

    def encode(self, text: str) -> bytes:
        return self.encode_all(pa.array([text]))[0]

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """Ids of every text; each distinct word of a chunk is looked up once."""
        out: list[bytes] = []
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        begin = 0
        while begin < len(texts):
            base = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, base + _CHUNK, side="right")))
            out += self._chunk(texts[begin:end].to_pylist())
            begin = end
        return out

    def _splits(self, text: str) -> bool:
        """Do the ids of the words make up those of the text?"""
        plain = text.isascii() or ("Σ" not in text and unicodedata.is_normalized("NFC", text))
        return self.by_word and plain and not any(t in text or t in text.lower() for t in self.special)

    def _chunk(self, texts: list[str]) -> list[bytes]:
        split = [i for i, t in enumerate(texts) if self._splits(t)]
        out = dict.fromkeys(range(len(texts)), b"")
        for i in set(out).difference(split):
            out[i] = self.whole(texts[i])
        if split:
            out.update(zip(split, self._by_word([texts[i].lower() for i in split]), strict=True))
        return list(out.values())

    def _by_word(self, texts: list[str]) -> list[bytes]:
        if len(self.kept) > self.most_kept:
            self.kept.clear()
        words = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " "), " ")
        coded = pc.list_flatten(words).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if self.ranked:
            new = {(m[1] if (m := _SIGNED.fullmatch(w)) else w) for w in distinct if w not in self.kept}
            new = [w for w in new if _WORD.fullmatch(w) and w not in self.kept]
            self.kept.update(zip(new, self.ranked.encode(new, f"<u{self.width}"), strict=True))
        known = [self.kept[w] for w in distinct]
        size = np.array([len(k) // self.width for k in known], dtype=np.int64)
        ids = np.frombuffer(b"".join(known), dtype=f"<u{self.width}")
        word = coded.indices.to_numpy()
        ends = np.append(0, np.cumsum(size[word]))
        # The place in ``ids`` of every id: its word's first one, and so on from there.
        first = (np.cumsum(size) - size)[word] - ends[:-1]
        data = memoryview(ids[np.repeat(first, size[word]) + np.arange(ends[-1])].tobytes())
        edges = ends[np.append(0, np.cumsum(pc.list_value_length(words).to_numpy()))] * self.width
        return [bytes(data[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def byte_of_letter() -> dict[str, int]:
    """Byte-level vocabularies write a byte as a letter: printable Latin-1 as itself, others from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class _Ranked:
    """Ids of words of Latin letters, many at once, by the ranks of what merges give.

    ``tiktoken`` knows no word ends. So a word's end is a letter of its own here, which
    joins the last byte before anything else is merged.
    """

    END = "|"

    def __init__(self, model: dict):
        suffix, vocab, letters = model["end_of_word_suffix"], model["vocab"], byte_of_letter()
        ids = {bytes([b]): vocab.get(c, -1) for c, b in letters.items()}
        ids |= {bytes([b]) + self.END.encode(): vocab.get(c + suffix, -1) for c, b in letters.items()}
        for merge in model["merges"]:
            token = "".join(merge.split(" ") if isinstance(merge, str) else merge)
            word = bytes(letters[c] for c in token.removesuffix(suffix))
            ids.setdefault(word + self.END.encode() * token.endswith(suffix), vocab[token])
        self.ids = np.array(list(ids.values()))
        self.last = np.array([len(word) > 1 and word.endswith(self.END.encode()) for word in ids])
        self.merger = tiktoken.Encoding(
            "words", pat_str="[^|]+[|]", mergeable_ranks={w: i for i, w in enumerate(ids)}, special_tokens={}
        )

    def encode(self, words: list[str], kind: str) -> list[bytes]:
        ranks = np.array(self.merger.encode_ordinary("".join(w + self.END for w in words)), dtype=np.int64)
        data = self.ids[ranks].astype(kind)
        ends = np.append(0, np.flatnonzero(self.last[ranks]) + 1) * data.itemsize
        view = memoryview(data.tobytes())
        return [bytes(view[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]


class _Kept(dict):
    def __init__(self, encoder: Encoder):
        super().__init__({"": b""})
        self.encoder = encoder

    def clear(self) -> None:
        super().clear()
        self[""] = b""

    def __missing__(self, word: str) -> bytes:
        if mixed := _SIGNED.fullmatch(word):  # signs are cut from letters, and cheap to put together
            return self[mixed[1]] + self[mixed[2]]
        self[word] = ids = self.encoder.whole(word)
        return ids
