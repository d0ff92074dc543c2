"""Language-model scores by a weighted backoff automaton over word trigrams.

States are histories: the root (none), words (and the start of a text), pairs of words. A history of the training texts
has an arc for each word that follows it there, with the smoothed log-probability as weight; the arc leads to the
longest history that ends with that word. For any other word the state's failure arc adds the weight of backing off and
leads to the history without its first word; the root has an arc for every word, seen or not. One left-to-right
traversal of a text carries the state and adds up the weights. As an arc leads to the longest history that was seen, the
state before a token follows from the two words before it, so the traversals of a chunk are done for all tokens at once:
which state each token finds, which failure arcs it falls along, which arc takes it. Smoothing is hierarchical with Dirichlet priors:

    p(w)       = (c(w) + 1) / (N + V + 1)
    p(w | v)   = (c(v w) + K2 p(w)) / (c(v) + K2)            failure arc: K2 / (c(v) + K2)
    p(w | u v) = (c(u v w) + K3 p(w | v)) / (c(u v) + K3)    failure arc: K3 / (c(u v) + K3)

so every distribution sums to 1 (all unseen words together count as one). No n-gram is left out, however rare, and
no threshold depends on the size of the corpus.

Counting and scoring share their shuffles, and nothing is broadcast. The words of about ``CHUNK`` tokens of text, numbered
within the chunk, are one row of a saved table. Each chunk sends its distinct n-grams, once each, with their counts in
training texts (sorted 64-bit hashes, dealt out by their first bits, as compressed blobs) and gets the counts over all
chunks back in the same order, with a mark whether any other chunk has the n-gram. Words and pairs go first; triples
go only where other chunks have both of their pairs, as otherwise the chunk itself holds all their occurrences. From its
counts each chunk then builds the part of the automaton that its texts can reach, and its texts traverse it. A blob goes
from a chunk to a bucket, so a frequent n-gram is one entry a chunk, and memory is bounded by a chunk or a bucket
(``BUCKET`` entries on average). Two words of equal hash would count as one (expected once in about four thousand million words).

Null and empty texts have one token, the end. The id of a null counts as the empty text in the split. Repeated rows are
counted and scored each. Very long texts are chunks of their own. Without training texts every word is unseen; without
documents there is no row. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucket, given_back, saved, tidied

#: tokens of a chunk (a text is never cut), entries of a bucket on average
CHUNK, BUCKET = 300_000, 1_000_000
#: strength of the priors of pairs and triples, in occurrences
K2, K3 = 8.0, 4.0
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: stands for the start of a text; its end is the empty word
START = np.uint64(0x5851F42D4C957F2D)
TEXTS = "chunk long, ids array<long>, held array<boolean>, sizes array<int>, words binary, tokens binary"
SENT = "chunk long, n_order int, bucket long, n int, keys binary, counts binary"
BACK = "chunk long, n_order int, bucket long, n int, counts binary, kinds long"


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").lower().split()


def pack(x: np.ndarray) -> bytes:
    """Unsigned integers as planes of bytes, compressed."""
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T), codec="zstd", asbytes=True) if len(x) else b""


def unpack(raw: bytes, n: int, kind=np.uint64) -> np.ndarray:
    if not n:
        return np.empty(0, dtype=kind)
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(raw, decompressed_size=n * size, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(kind).reshape(n)


def _arrow(df: DataFrame, schema: str):
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = df.sparkSession.createDataFrame([], schema).schema
    return fields, to_arrow_schema(fields)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)


# ------------------------------------------------------------------ chunks


def chunks(df: DataFrame, doc_id: str, text: str, held: Column) -> DataFrame:
    """The texts as rows of TEXTS: hashes of a chunk's words in ascending order, and its tokens as places in them."""
    fields, schema = _arrow(df, TEXTS)
    end = xxhash.xxh3_64_intdigest(b"")
    size = CHUNK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 36
        known: dict[bytes, int] = {b"": 0}
        flat: list[int] = []
        docs: tuple[list, list, list] = ([], [], [])

        def out() -> pa.RecordBatch:
            h = np.fromiter((xxhash.xxh3_64_intdigest(w) if w else end for w in known), dtype=np.uint64, count=len(known))
            words, place = np.unique(h, return_inverse=True)
            row = (chunk, *docs, pack(np.diff(words, prepend=np.uint64(0))), pack(place[np.array(flat, dtype=np.int64)].astype(np.uint32)))
            return _table([row], schema).to_batches()[0]

        with given_back():
            for b in batches:
                for i, h, t in zip(*(c.to_pylist() for c in b.columns)):
                    before = len(flat)
                    number = known.setdefault
                    flat += [number(w, len(known)) for w in tokens(t)]
                    flat.append(0)
                    for column, x in zip(docs, (i, h, len(flat) - before)):
                        column.append(x)
                    if len(flat) >= size:
                        yield out()
                        chunk += 1
                        known, flat, docs = {b"": 0}, [], ([], [], [])
            if flat:
                yield out()

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), held.alias("held"), F.col(text).cast("string")).mapInArrow(run, fields)


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different values in ascending order, a place of each, and which one stands at each place."""
    order = np.argsort(x)
    ascending = x[order]
    new = np.r_[True, ascending[1:] != ascending[:-1]] if len(x) else np.empty(0, dtype=bool)
    which = np.empty(len(x), dtype=np.int64)
    which[order] = np.cumsum(new) - 1
    return ascending[new], order[new], which


class Chunk:
    """The n-grams of a chunk: for each order distinct ones in the order of their hashes, and which one each token ends."""

    def __init__(self, ids, held, sizes, words: bytes, raw: bytes):
        self.ids, self.held = ids, held
        self.sizes = np.array(sizes, dtype=np.int64)
        self.ends = np.cumsum(self.sizes)
        self.first = self.ends - self.sizes
        n = int(self.ends[-1])
        a = unpack(raw, n, np.uint32).astype(np.int64)
        self.learnt = np.repeat(~np.array(held, dtype=bool), self.sizes)
        # the number of words is not stored: the largest place is always used
        h = np.cumsum(unpack(words, int(a.max()) + 1), dtype=np.uint64)
        self.n_words, self.a = len(h), a
        self.before = before = np.r_[self.n_words, a[:-1]]
        before[self.first] = self.n_words
        h = np.r_[h, START]
        pair = h[before] * _A + (h[a] ^ h[before] >> np.uint64(29)) * _B
        pair ^= pair >> np.uint64(31)
        self.pairs, at, self.pair = distinct(pair)
        self.pair_from, self.pair_to = before[at], a[at]
        #: tokens with two words (or the start and a word) before them
        self.deep = np.ones(n, dtype=bool)
        self.deep[self.first] = False
        self.deep = np.flatnonzero(self.deep)
        triple = pair[self.deep - 1] * _B + h[a[self.deep]] * _A
        triple ^= triple >> np.uint64(32)
        self.triples, at, self.triple = distinct(triple)
        at = self.deep[at]
        self.triple_from, self.triple_to, self.triple_word = self.pair[at - 1], self.pair[at], a[at]
        self.words = h[:-1]

    def own(self, order: int) -> np.ndarray:
        """Counts of the n-grams in the training texts of this chunk."""
        if order == 1:
            return np.bincount(self.a[self.learnt], minlength=self.n_words)
        if order == 2:
            return np.bincount(self.pair[self.learnt], minlength=len(self.pairs))
        return np.bincount(self.triple[self.learnt[self.deep]], minlength=len(self.triples))

    def open_triples(self, shared: np.ndarray) -> np.ndarray:
        """The triples that other chunks may have, given which pairs others have."""
        return np.flatnonzero(shared[self.triple_from] & shared[self.triple_to])


def _read(t: pa.Table | pa.RecordBatch, k: int = 0) -> Chunk:
    return Chunk(*(t[c][k].as_py() for c in ("ids", "held", "sizes", "words", "tokens")))


# ------------------------------------------------------------------ counts


def sent(chunk: int, order: int, keys: np.ndarray, counts: np.ndarray, buckets: int) -> list[tuple]:
    """Rows of SENT: ascending keys cut into buckets by their first bits."""
    number = (keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    cuts = np.flatnonzero(np.diff(number)) + 1
    out = []
    for k, c in zip(np.split(keys, cuts), np.split(counts.astype(np.uint64), cuts)):
        if len(k):
            at = int((int(k[0]) >> 32) * buckets >> 32)
            out.append((chunk, order, at, len(k), pack(np.diff(k, prepend=np.uint64(0))), pack(c)))
    return out


def summed(rows: DataFrame) -> DataFrame:
    """Rows of BACK: for each blob of SENT the counts over all chunks, times two, plus one where several chunks have the key.

    kinds: distinct keys of the bucket that training texts have, in one row of it.
    """
    fields, schema = _arrow(rows, BACK)

    def one(t: pa.Table) -> pa.Table:
        out = []
        orders = t["n_order"].to_numpy()
        for order in np.unique(orders):
            part = t.filter(pa.array(orders == order))
            chunk, bucket_, n = (part[c].to_pylist() for c in ("chunk", "bucket", "n"))
            keys = np.concatenate([np.cumsum(unpack(k.as_py(), m), dtype=np.uint64) for k, m in zip(part["keys"], n)])
            counts = np.concatenate([unpack(k.as_py(), m) for k, m in zip(part["counts"], n)])
            del part
            order_ = np.argsort(keys, kind="stable")
            new = np.r_[True, np.diff(keys[order_]) > 0]
            first = np.flatnonzero(new)
            total = np.add.reduceat(counts[order_], first)
            several = np.diff(np.r_[first, len(keys)]) > 1
            back = np.empty(len(keys), dtype=np.uint64)
            back[order_] = (total * np.uint64(2) + several.astype(np.uint64))[np.cumsum(new) - 1]
            kinds = [int((total > 0).sum())] + [0] * (len(n) - 1)
            blobs = map(pack, np.split(back, np.cumsum(n)[:-1]))
            out += zip(chunk, [int(order)] * len(n), bucket_, n, blobs, kinds)
        return _table(out, schema)

    return rows.groupBy("bucket").applyInArrow(one, fields)


def returned(back: pa.Table, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts over all chunks and whether other chunks have the key, in the order of the chunk's keys."""
    part = back.filter(pa.array(back["n_order"].to_numpy() == order)).sort_by("bucket")
    both = [unpack(c.as_py(), m) for c, m in zip(part["counts"], part["n"].to_pylist())]
    x = np.concatenate(both) if both else np.empty(0, dtype=np.uint64)
    return (x >> np.uint64(1)).astype(np.int64), (x & np.uint64(1)).astype(bool)


def _words_and_pairs(texts: DataFrame, buckets: int) -> DataFrame:
    fields, schema = _arrow(texts, SENT)

    def run(batches):
        with given_back():
            for b in batches:
                for k in range(b.num_rows):
                    c, chunk = _read(b, k), b["chunk"][k].as_py()
                    rows = sent(chunk, 1, c.words, c.own(1), buckets) + sent(chunk, 2, c.pairs, c.own(2), buckets)
                    yield from _table(rows, schema).to_batches()

    return texts.mapInArrow(run, fields)


def _per_chunk(texts: DataFrame, back: DataFrame, fn: Callable[[int, pa.Table, pa.Table], list[tuple]], schema: str) -> DataFrame:
    """``fn(chunk, its row, its returned blobs)`` for each chunk."""
    fields, arrow = _arrow(texts, schema)

    def one(row: pa.Table, blobs: pa.Table) -> pa.Table:
        return _table(fn(row["chunk"][0].as_py(), row, blobs), arrow)

    return texts.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(one, fields)


# ------------------------------------------------------------------ the automaton


class Automaton:
    """The states and arcs that the texts of a chunk can reach, by the numbers of their n-grams.

    Words (the last one is the start) and pairs with a count are states besides the root. The arc of a pair for a word is a
    triple with a count, that of a word a pair with a count; the root has one for every word.
    """

    def __init__(self, c: Chunk, one, two, three, total: int, kinds: int):
        self.c = c
        # the start precedes as many texts as the end closes; the end is the word of every text's last token
        one = np.r_[one, one[c.a[c.ends[0] - 1]]].astype(np.float64)
        two, three = two.astype(np.float64), three.astype(np.float64)
        self.log_one = np.log10(one[:-1] + 1) - math.log10(total + kinds + 1)
        p2 = (two + K2 * 10 ** self.log_one[c.pair_to]) / (one[c.pair_from] + K2)
        p3 = (three + K3 * p2[c.triple_to]) / (two[c.triple_from] + K3)
        self.is_word, self.is_pair, self.is_triple = one > 0, two > 0, three > 0
        self.log_two, self.log_three = np.log10(p2), np.log10(p3)
        self.fail_word, self.fail_pair = np.log10(K2 / (one + K2)), np.log10(K3 / (two + K3))

    def scores(self) -> np.ndarray:
        """The log10 probability of each text."""
        c = self.c
        n = len(c.a)
        seen = self.is_pair[c.pair]
        # the state that a token finds: the pair before it, else the word before it, else the root
        at_pair = np.zeros(n, dtype=bool)
        at_pair[c.deep] = seen[c.deep - 1]
        weight = np.zeros(n)
        done = np.zeros(n, dtype=bool)
        done[c.deep] = at_pair[c.deep] & self.is_triple[c.triple]
        took = done[c.deep]
        weight[c.deep[took]] = self.log_three[c.triple[took]]
        falls = np.flatnonzero(at_pair & ~done)
        weight[falls] += self.fail_pair[c.pair[falls - 1]]
        at_word = ~done & self.is_word[c.before]
        arc = at_word & seen
        weight[arc] += self.log_two[c.pair[arc]]
        falls = at_word & ~seen
        weight[falls] += self.fail_word[c.before[falls]]
        root = ~done & ~arc
        weight[root] += self.log_one[c.a[root]]
        return np.add.reduceat(weight, c.first)


def counted(c: Chunk, back: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of the chunk's words, pairs and triples in all training texts."""
    one, _ = returned(back, 1)
    two, shared = returned(back, 2)
    three = c.own(3)
    three[c.open_triples(shared)], _ = returned(back, 3)
    return one, two, three


def scored(df: DataFrame, doc_id: str = "doc_id", text: str = "text", folds: int = 7, held: int = 2) -> DataFrame:
    """One row per document of ``df`` with its score by a model of the rows outside fold ``held``, and the unigram base score.

    The result is a saved table; everything before it is removed.
    """
    with tidied():
        return saved(_scored(df, doc_id, text, folds, held), "scores", keep=True)


def _scored(df: DataFrame, doc_id: str, text: str, folds: int, held: int) -> DataFrame:
    texts = saved(chunks(df, doc_id, text, bucket(doc_id, folds) == held), "texts")
    n = F.aggregate(F.arrays_zip("held", "sizes"), F.lit(0).cast("long"), lambda s, x: s + F.when(x["held"], 0).otherwise(x["sizes"]))
    total, every = texts.agg(F.coalesce(F.sum(n), F.lit(0)), F.coalesce(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda s, x: s + x)), F.lit(0))).first()
    buckets = max(4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(1.5 * every / BUCKET))

    shallow = saved(summed(_words_and_pairs(texts, buckets)), "pairs")
    kinds = shallow.where("n_order = 1").agg(F.coalesce(F.sum("kinds"), F.lit(0))).first()[0]

    def triples(chunk: int, row: pa.Table, back: pa.Table) -> list[tuple]:
        c = _read(row)
        at = c.open_triples(returned(back, 2)[1])
        return sent(chunk, 3, c.triples[at], c.own(3)[at], buckets)

    deep = saved(summed(_per_chunk(texts, shallow.where("n_order = 2"), triples, SENT)), "triples")

    def scores(chunk: int, row: pa.Table, back: pa.Table) -> list[tuple]:
        c = _read(row)
        one, two, three = counted(c, back)
        model = Automaton(c, one, two, three, total, kinds)
        known = np.add.reduceat((one > 0)[c.a].astype(np.int64), c.first).tolist()
        base = np.add.reduceat(model.log_one[c.a], c.first).tolist()
        return list(zip(c.ids, c.held, c.sizes.tolist(), known, [total] * len(c.ids), base, model.scores().tolist()))

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return _per_chunk(texts, shallow.unionByName(deep), scores, schema)
