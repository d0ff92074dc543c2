"""Byte-level BPE by a pair occurrence index.

The distinct pieces of a batch that the worker has not met yet are laid end to end. An index maps each pair
that has a merge rank to all its positions. Active ranks are taken in ascending order from a heap; all
positions of a rank are merged at once and the lists of the neighbouring pairs are updated. As pieces never
touch, the order of merges inside every piece is the order of ranks, which is what BPE asks for.

Null and empty texts have no token; very long texts are encoded whole. The added tokens of the file are cut out of the
text first, with the white space and word limits that their attributes ask for, as the tokenizers library does. Repeated
rows give repeated results; without documents there is no row. Columns besides are not read (digests) or pass through.
"""

from __future__ import annotations

import heapq
import json
import re
import sys
import unicodedata
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_columns, with_columns

#: pieces that a worker remembers; beyond it the memory starts afresh (only speed depends on it)
REMEMBERED = 250_000

#: fixed value: how the tokenizer splits a text before the merges
_PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?{L}+| ?{N}+| ?[^\s\p{{L}}\p{{N}}]+|\s+(?!\S)|\s+"""
_FAST = regex.compile(_PIECES.format(L=r"\p{L}", N=r"\p{N}"))
_LATER = re.compile("[԰-\U0010ffff]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary of a byte-level tokenizer."""
    shown = [b for b in range(256) if chr(b).isprintable() and not chr(b).isspace() and b != 0xAD]
    out = [""] * 256
    extra = 0
    for b in range(256):
        if b in shown:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return out


def _unassigned() -> str:
    """Code points that the regex module counts as letters or numbers and older Unicode tables don't know."""
    new = "".join(
        chr(c) for c in range(0x530, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) == "Cn"
    )
    found = [ord(m[0]) for m in regex.finditer(r"[\p{L}\p{N}]", new)]
    runs: list[list[int]] = []
    for c in found:
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)


class Bpe:
    """Merges, byte values and special tokens of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        symbols = byte_symbols()
        value = {s: b for b, s in enumerate(symbols)}
        self.added = [(t["content"], t["id"], *(bool(t.get(k)) for k in ("lstrip", "rstrip", "single_word"))) for t in spec.get("added_tokens", [])]
        self.special = {t[0]: t[1] for t in self.added}
        self.first = [vocab[s] for s in symbols]
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.pieces = [b""] * size
        for token, i in vocab.items():
            self.pieces[i] = bytes(value[c] for c in token)
        for token, i in self.special.items():
            self.pieces[i] = token.encode()
        self.merges = []
        for m in spec["model"]["merges"]:
            a, b = m if isinstance(m, list) else m.split(" ")
            self.merges.append((vocab[a], vocab[b], vocab[a + b]))
        self.later = _unassigned()
        self.start()

    def start(self) -> None:
        self.rank = {a << 24 | b: r for r, (a, b, _) in reversed(list(enumerate(self.merges)))}
        self.known: dict[str, bytes] = {}
        self.stop = len(self.pieces)
        self.at_first = np.full((257, 257), -1, dtype=np.int64)
        of = {i: b for b, i in enumerate(self.first)}
        for r in range(len(self.merges) - 1, -1, -1):
            a, b, _ = self.merges[r]
            if a in of and b in of:
                self.at_first[of[a], of[b]] = r
        self.exact = regex.compile(
            r"(?V1)" + _PIECES.format(L=rf"[\p{{L}}--[{self.later}]]", N=rf"[\p{{N}}--[{self.later}]]").replace(
                r"[^\s\p{L}\p{N}]", rf"[[^\s\p{{L}}\p{{N}}]||[{self.later}]]"
            )
            if self.later
            else _FAST.pattern
        )
        added = sorted(self.added, key=lambda t: -len(t[0]))
        self.added_ids = [0, *(t[1] for t in added)]
        shown = (
            f"({r'\s*' * left}{r'(?<!\w)' * whole}{re.escape(token)}{r'(?!\w)' * whole}{r'\s*' * right})" for token, _, left, right, whole in added
        )
        self.cut = re.compile("|".join(shown)) if added else None

    def __getstate__(self):
        return {k: self.__dict__[k] for k in ("added", "special", "first", "pieces", "merges", "later")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.start()

    def split(self, text: str) -> list[str]:
        return (self.exact if _LATER.search(text) else _FAST).findall(text)

    def learn(self, words: list[str]) -> None:
        """Encodes new pieces together and remembers them."""
        raw = [w.encode("utf-8") for w in words]
        flat = np.full(sum(map(len, raw)) + len(raw), 256, dtype=np.int64)
        ends = np.cumsum([len(w) + 1 for w in raw]) - 1
        inside = np.ones(len(flat), dtype=bool)
        inside[ends] = False
        flat[inside] = np.frombuffer(b"".join(raw), dtype=np.uint8)
        n = len(flat)
        ids = np.array([*self.first, self.stop], dtype=np.int64)[flat]
        ranks = self.at_first[flat[:-1], flat[1:]] if n > 1 else np.empty(0, dtype=np.int64)
        at = np.flatnonzero(ranks >= 0)
        order = at[np.argsort(ranks[at], kind="stable")]
        found, starts = np.unique(ranks[order], return_index=True)
        places = {
            int(r): p.tolist() for r, p in zip(found, np.split(order, starts[1:]))
        }
        active = list(places)
        heapq.heapify(active)
        sym = ids.tolist()
        sym.append(self.stop)
        nxt = list(range(1, n + 2))
        prv = list(range(-1, n))
        rank, merges = self.rank.get, self.merges
        while active:
            r = heapq.heappop(active)
            a, b, c = merges[r]
            where = places.pop(r)
            where.sort()
            for i in where:
                if sym[i] != a:
                    continue
                j = nxt[i]
                if sym[j] != b:
                    continue
                k = nxt[j]
                sym[i] = c
                sym[j] = -1
                nxt[i] = k
                prv[k] = i
                p = prv[i]
                if p >= 0:
                    q = rank(sym[p] << 24 | c)
                    if q is not None:
                        if q in places:
                            places[q].append(p)
                        else:
                            places[q] = [p]
                            heapq.heappush(active, q)
                q = rank(c << 24 | sym[k])
                if q is not None:
                    if q in places:
                        places[q].append(i)
                    else:
                        places[q] = [i]
                        heapq.heappush(active, q)
        left = np.array(sym[:n], dtype=np.int64)
        left = left[left >= 0]
        ends = np.flatnonzero(left == self.stop)
        data = left.astype("<u4").tobytes()
        begin = 0
        for w, e in zip(words, ends.tolist()):
            self.known[w] = data[begin * 4 : e * 4]
            begin = e + 1

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.known) > REMEMBERED:
            self.known = {}
        parts: list[list[list[str] | int]] = []
        new: dict[str, None] = {}
        known = self.known
        for text in texts:
            out: list[list[str] | int] = []
            begin = 0
            for m in self.cut.finditer(text) if self.cut else ():
                out += [self.split(text[begin : m.start()]), self.added_ids[m.lastindex]]
                begin = m.end()
            out.append(self.split(text[begin:] if begin else text))
            for words in out:
                if not isinstance(words, int):
                    new.update((w, None) for w in set(words).difference(known))
            parts.append(out)
        if new:
            self.learn(list(new))
        return [
            b"".join(
                x.to_bytes(4, "little") if isinstance(x, int) else b"".join(map(known.__getitem__, x)) for x in out
            )
            for out in parts
        ]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")


def _model(spark: SparkSession, path: str):
    """The vocabulary has a fixed size (a file of a few MB), so it is broadcast."""
    return spark.sparkContext.broadcast(Bpe(path))


def _lists(parts: list[bytes]) -> pa.Array:
    offsets = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(p) // 4 for p in parts], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), dtype="<i4")))


def encode(df: DataFrame, tokenizer_path: str, text: str = "text", output: str = "ids") -> DataFrame:
    """Adds ``output``, the ids of each whole text (array of int; null text: empty)."""
    shared = _model(df.sparkSession, tokenizer_path)

    def start():
        return lambda texts: [_lists(shared.value.encode_batch([t or "" for t in texts]))]

    return with_columns(df, text, f"`{output}` array<int>", start)


def decode(df: DataFrame, tokenizer_path: str, ids: str = "ids", output: str = "text") -> DataFrame:
    """Adds ``output``, the text of each list of ids (null: empty)."""
    shared = _model(df.sparkSession, tokenizer_path)

    def start():
        back = shared.value.decode
        return lambda lists: [pa.array([back(np.asarray(x or [], dtype="<u4").tobytes()) for x in lists], type=pa.string())]

    return with_columns(df, ids, f"`{output}` string", start)


def tokenise(df: DataFrame, tokenizer_path: str, text: str = "text") -> DataFrame:
    """Adds n_tokens, ids and decoded (the text that these ids give) in one pass; columns of these names are replaced."""
    shared = _model(df.sparkSession, tokenizer_path)

    def start():
        model = shared.value

        def work(texts):
            ids = model.encode_batch([t or "" for t in texts])
            n = pa.array([len(x) // 4 for x in ids], type=pa.int64())
            return [n, _lists(ids), pa.array(list(map(model.decode, ids)), type=pa.string())]

        return work

    return with_columns(df, text, "n_tokens long, ids array<int>, decoded string", start, rows=250)


def round_trip(df: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: number of tokens and digests of its ids and of the text decoded from them."""
    shared = _model(df.sparkSession, tokenizer_path)

    def start():
        model = shared.value

        def work(keys, texts):
            n, of_ids, of_text = [], [], []
            for ids in model.encode_batch([t or "" for t in texts]):
                n.append(len(ids) // 4)
                of_ids.append(sha256(ids).hexdigest())
                of_text.append(sha256(model.decode(ids).encode("utf-8")).hexdigest())
            return [keys, n, of_ids, of_text]

        return work

    return map_columns(
        df,
        [F.col(doc_id).cast("long").alias("doc_id"), text],
        "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string",
        start,
        rows=250,
    )
