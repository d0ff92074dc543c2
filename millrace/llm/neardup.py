"""Near-duplicate documents by bottom-k sketches of one hash function.

A document's set is its distinct shingles of ``size`` words (lower-cased A-Z, split at ASCII white space); with
fewer words the whole sequence is one shingle. Documents are linked when 100 * |A and B| >= percent * |A or B|.

1. Each text gives the ``k`` smallest hashes of its set (the sketch), the size of the set, a digest of the
   whole set and a parity bitmap (bit i: how many hashes fall on i, modulo 2).
2. Documents with equal digests are one class; the rest works on classes.
3. Inverted lists: a linked pair shares at least t of its retained values, so it shares one of the k - t + 1
   rarest of either sketch (prefix filter; the rarity of every value is counted). For sets whose union fits the
   sketch t is exact; else t lies 5.5 standard deviations below the mean overlap at the threshold. Values in a
   single sketch make no list.
4. Lists of more than ``BLOCK`` classes have a pivot, their first class. Each member that passes the filter of step 3
   against it is verified, so near copies of one text hang together after one comparison each; pairs that already
   hang together are not compared again, and a list whose members all do is done.
5. Lists are compared in blocks of ``BLOCK`` classes, so no list, however long, meets in one task. In a long list the
   largest part that hangs together fills blocks of its own, which meet only the blocks of the other members. A pair that
   shares several lists is compared in the first of them only. Differing
   parity bits bound the symmetric difference from below: pairs beyond the bound cannot be linked. Of the others
   a spanning forest is handed on, not all pairs, and besides all pairs of rows that have few and only doubtful
   ones. The estimate from the union of two sketches filters these edges.
6. Edges are verified on the full sets. Where one of the forest fails between parts that stay apart, all remaining
   pairs of that block which the bounds allow are verified as well, so no link is lost.
7. Connected components by large-star and small-star steps on tables.

Sketches of more values are exact for larger sets; with ``Rule(k=EXACT)`` a sketch is the whole set, so the bound of
step 3 holds for all sets and nothing rests on probability. Broadcasts are limited by ``BROADCAST_ROWS`` and
``BROADCAST_VALUES``, which are counted first; beyond them the same join is shuffled. In tables of more than ``FEW_ROWS``
rows, keys of more than ``HUB`` rows (large groups, hubs of components) are looked up in such a broadcast, so they don't
meet in one task. These bounds change plans, never results.

A document without words or text has an empty set and is linked with nothing; without documents there is no row. Very
long texts are taken whole. Without an id a document can be linked, but is never the smallest; where a whole group has
no id its component_id is null. Repeated rows are exact copies. Ties don't arise: components are named by their
smallest id. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, given_back, saved, tidied, unused, without

BLOCK = 512
BITS = 2048
#: allowed pairs of a doubtful row up to which all are verified at once
FEW = 16
#: row numbers that are broadcast at most (16 bytes each), and hashes of sets (8 bytes each)
BROADCAST_ROWS, BROADCAST_VALUES = 2_000_000, 4_000_000
#: rows of a key from which it is hot, and of a table up to which any task can take them all
HUB, FEW_ROWS = 500, 20_000
#: a sketch size that no set exceeds
EXACT = 1 << 31
_M, _A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


@dataclass(frozen=True)
class Rule:
    size: int = 5
    percent: int = 80
    k: int = 64
    sigmas: float = 5.5

    @property
    def exact_up_to(self) -> int:
        """Sets up to this size have all unions with partners inside the sketch."""
        return self.k * self.percent // 100

    @property
    def least(self) -> int:
        j = self.percent / 100
        return max(1, int(self.k * j - self.sigmas * (self.k * j * (1 - j)) ** 0.5))

    def shared(self, n: Column) -> Column:
        """How many of its retained values a set of ``n`` shares with a partner at least."""
        return F.when(n <= self.exact_up_to, F.ceil(n * self.percent / 100)).otherwise(self.least)


def shingles(text: str | None, size: int, known: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], dtype=np.uint64)
    if len(known) > 400_000:
        known.clear()
    w = np.empty(len(words), dtype=np.uint64)
    w[:] = [known[x] if x in known else known.setdefault(x, xxhash.xxh3_64_intdigest(x)) for x in words]
    n = len(w) - size + 1
    h = w[:n].copy()
    for i in range(1, size):
        h *= _M
        h += w[i : i + n]
    h ^= h >> np.uint64(31)
    h *= _A
    h ^= h >> np.uint64(29)
    h *= _B
    h ^= h >> np.uint64(32)
    return np.unique(h)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    values = np.concatenate(parts).view(np.int64) if parts else np.empty(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _mapped(df: DataFrame, run, schema: str) -> DataFrame:
    fields = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(fields)

    def batches(it):
        with given_back():
            for cols in run(it):
                yield pa.RecordBatch.from_arrays(
                    [(c if isinstance(c, pa.Array) else pa.array(c)).cast(f.type) for c, f in zip(cols, arrow)], schema=arrow
                )

    return df.mapInArrow(batches, fields)


def _keyed(documents: DataFrame) -> DataFrame:
    return documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text")
    )


def sketches(documents: DataFrame, rule: Rule) -> DataFrame:
    """(row, doc_id, th, digest, n, sketch, parity) of every document."""

    def run(batches):
        known: dict[bytes, int] = {}
        row = TaskContext.get().partitionId() << 36
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                sets = [shingles(t, rule.size, known) for t in part["text"].to_pylist()]
                digest = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                parity = [
                    np.packbits((np.bincount((s & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1).astype(np.uint8)).tobytes()
                    for s in sets
                ]
                rows = np.arange(row, row + len(sets))
                row += len(sets)
                yield rows, part["doc_id"], part["th"], digest, [len(s) for s in sets], _lists([s[: rule.k] for s in sets]), parity

    return _mapped(_keyed(documents), run, "row long, doc_id long, th long, digest binary, n long, sketch array<long>, parity binary")


def _small(ids: DataFrame) -> DataFrame:
    """Marks a table of row numbers for broadcast if its size allows it."""
    return F.broadcast(ids) if ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else ids


def inverted_lists(reps: DataFrame, rule: Rule) -> DataFrame:
    """(v, row, own, m): for each value that is among the rarest of two sketches or more, its classes and their number.

    own: all values of the class that are among its rarest.
    """
    entry = reps.select("row", "n", F.explode("sketch").alias("v"))
    shared = entry.groupBy("v").agg(F.count("*").alias("c")).where("c > 1")
    own = entry.join(shared, "v").groupBy("row").agg(F.first("n").alias("n"), F.collect_list(F.struct("c", "v")).alias("l"))
    kept = F.least(F.col("n"), F.lit(rule.k))
    take = (kept - rule.shared(F.col("n")) + 1 - (kept - F.size("l"))).cast("int")  # values of no other sketch come first and make no list
    prefix = own.withColumn("take", take).where("take > 0").select("row", F.slice(F.array_sort("l"), F.lit(1), F.col("take")).alias("l"))
    own = prefix.select("row", F.transform("l", lambda x: x["v"]).alias("own"))
    rows = own.select(F.explode_outer("own").alias("v"), "row", "own")
    long = rows.groupBy("v").agg(F.count("*").alias("m")).where("m > 1")
    return rows.join(long, "v")


def hot_join(left: DataFrame, right: DataFrame, key: str, n: str, rows: int) -> DataFrame:
    """Inner join with ``right``, whose column ``n`` tells how many of the ``rows`` rows of ``left`` its key has (it is dropped).

    Hot keys are broadcast if they are few enough; adaptive execution has to split them otherwise.
    """
    if rows <= FEW_ROWS:
        return left.join(right.drop(n), key)
    hot = saved(right.where(F.col(n) > HUB).drop(n), "hot")
    found = hot.limit(BROADCAST_ROWS + 1).count()
    if not 0 < found <= BROADCAST_ROWS:
        discard(hot)
        return left.join(right.drop(n), key)
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(right.where(F.col(n) <= HUB).drop(n), key)
    return left.join(F.broadcast(hot), key).unionByName(rest)


def pivot_pairs(lists: DataFrame, sketched: DataFrame, rule: Rule) -> DataFrame:
    """(a, b): the pivots of long lists (a) and the members of these lists that share enough values with them."""
    long = lists.where(F.col("m") > BLOCK)
    pivots = long.groupBy("v").agg(F.min("row").alias("a"))
    pairs = saved(long.select("v", F.col("row").alias("b")).join(_small(saved(pivots, "pivots")), "v").where("a < b").select("a", "b").distinct(), "pivoted")
    side = lambda c: sketched.select(F.col("row").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))
    hubs = side("a").join(_small(saved(pairs.select("a").distinct(), "hubs")), "a", "left_semi")
    few = hubs.agg(F.coalesce(F.sum(F.size("s_a")), F.lit(0))).first()[0] <= BROADCAST_VALUES
    both = pairs.join(side("b"), "b").join(F.broadcast(hubs) if few else hubs, "a")
    a, b = F.col("n_a"), F.col("n_b")
    near = (F.least(a, b) * 100 >= F.greatest(a, b) * rule.percent) & (F.size(F.array_intersect("s_a", "s_b")) >= F.least(rule.shared(a), rule.shared(b)))
    return saved(both.where(near).select("a", "b"), "near")


def cut(lists: DataFrame, roots: DataFrame | None) -> DataFrame:
    """(v, i, j, row, side, own, label): each list as pairs of blocks of about BLOCK classes.

    roots: (node, root) of classes that already hang together. In long lists the largest part has the first blocks, which
    only meet blocks of other members.
    """
    own = {"label": F.col("row"), "big": F.lit(0).cast("long"), "mine": F.lit(False)}
    if roots is None:
        lists = lists.withColumns(own)
    else:
        long = lists.where(F.col("m") > BLOCK).join(roots.select(F.col("node").alias("row"), "root"), "row", "left")
        long = long.withColumn("label", F.coalesce("root", "row")).drop("root")
        parts = long.groupBy("v", "label").agg(F.count("*").alias("n"))
        largest = saved(parts.groupBy("v").agg(F.max(F.struct("n", "label")).alias("l")).select("v", F.col("l.n").alias("big"), F.col("l.label").alias("part")), "largest")
        long = long.join(_small(largest), "v").withColumn("big", F.when(F.col("big") > 1, F.col("big")).otherwise(0))
        long = long.withColumn("mine", (F.col("big") > 0) & (F.col("label") == F.col("part"))).drop("part")
        lists = lists.where(F.col("m") <= BLOCK).withColumns(own).unionByName(long)
    lists = lists.where("m > big")  # else all members hang together
    of = lambda n: F.ceil(n / BLOCK).cast("int")
    lists = lists.withColumn("first", of(F.col("big"))).withColumn("more", of(F.col("m") - F.col("big")))
    h = F.xxhash64("row")
    side = F.when(F.col("mine"), F.pmod(h, F.greatest("first", F.lit(1)))).otherwise(F.col("first") + F.pmod(h, F.col("more"))).cast("int")
    least = F.when(F.col("mine"), F.col("first")).otherwise(0)
    spread = lists.withColumn("side", side).withColumn("other", F.explode_outer(F.sequence(least, F.col("first") + F.col("more") - 1)))
    return spread.select("v", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "row", "side", "own", "label")


def blocks(lists: DataFrame, payload: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """The rows of ``cut`` with n, sketch and parity."""
    return cut(lists, roots).join(payload, "row")


def _estimate(a: np.ndarray, b: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Similarity from the k smallest of the union of two sketches (rows, padded with the largest number), and how many these are."""
    x = np.sort(np.concatenate([a, b], axis=1), axis=1)
    last = np.iinfo(np.uint64).max
    same = (x[:, 1:] == x[:, :-1]) & (x[:, 1:] != last)
    new = np.concatenate([np.ones((len(x), 1), dtype=bool), ~(x[:, 1:] == x[:, :-1])], axis=1) & (x != last)
    rank = new.cumsum(axis=1)
    used = np.minimum(rank[:, -1], k)
    both = (same & (rank[:, 1:] <= k)).sum(axis=1)
    return both / np.maximum(used, 1), used


def met_before(own: pa.ListArray, v: int) -> np.ndarray | None:
    """Which pairs of rows share a value below ``v``: they are compared in the list of that value. None: no pair does."""
    values = own.flatten().to_numpy()
    row = np.repeat(np.arange(len(own)), np.diff(own.offsets.to_numpy()))
    below = values < v
    found, at, times = np.unique(values[below], return_inverse=True, return_counts=True)
    shared = times > 1
    if not shared.any():
        return None
    number = np.cumsum(shared) - 1
    use = shared[at]
    has = np.zeros((len(own), int(shared.sum())), dtype=np.float32)
    has[row[below][use], number[at[use]]] = 1
    return (has @ has.T) > 0


def compare(n, parity, sketch, side, label, before, rule: Rule, everything: bool):
    """Edges (index, index, passes the estimate, is of the forest) of one block.

    side: block of each row where two blocks meet; None: one block. before: pairs that another list compares. A pair is allowed if the bounds don't
    exclude a link. A row is doubtful if none of its pairs lies clearly inside the bounds. All allowed pairs
    of doubtful rows with few of them are edges; of the other rows a spanning forest of their allowed pairs.
    Pairs of one label hang together already. With ``everything`` all allowed pairs are edges.
    """
    m = len(n)
    p = rule.percent
    bits = parity.shape[1] * 64
    far = np.full((m, m), np.inf, dtype=np.float32)
    sure = np.zeros(m, dtype=bool)
    step = max(1, (1 << 20) // (m * parity.shape[1]))
    for at in range(0, m, step):
        rows = slice(at, min(m, at + step))
        diff = np.bitwise_count(parity[rows, None, :] ^ parity[None, :, :]).sum(axis=2, dtype=np.int64)
        both = n[rows, None] + n[None, :]
        ok = diff * (100 + p) <= (100 - p) * both
        ok &= 100 * np.minimum(n[rows, None], n[None, :]) >= p * np.maximum(n[rows, None], n[None, :])
        if side is not None:
            ok &= side[rows, None] != side[None, :]
        ok &= label[rows, None] != label[None, :]
        if before is not None:
            ok &= ~before[rows]
        ok[np.arange(ok.shape[0]), np.arange(at, at + ok.shape[0])] = False
        far[rows] = np.where(ok, diff / both, np.inf)
        # differences that share a bit cancel out: the likely number of differences, and three deviations more
        likely = np.log1p(-np.minimum(2 * diff / bits, 0.999)) / np.log1p(-2 / bits)
        sure[rows] = (ok & (likely * (1 + 3 * (2 / bits) ** 0.5) * (100 + p) <= (100 - p) * both)).any(axis=1)
    allowed = np.isfinite(far)
    if everything:
        a, b = np.nonzero(np.triu(allowed, 1))
    else:
        closed = ~sure & (allowed.sum(axis=1) <= FEW)
        a, b = np.nonzero(np.triu(allowed & (closed[:, None] | closed[None, :]), 1))
        far[closed] = np.inf
        far[:, closed] = np.inf
        more = _forest(far)
        a, b = np.concatenate([a, more[0]]), np.concatenate([b, more[1]])
    forest = np.zeros(len(a), dtype=bool)
    if not everything:
        forest[len(a) - len(more[0]) :] = True
    if not len(a):
        return a, b, forest, forest
    fine = []
    for at in range(0, len(a), 4096):
        est, used = _estimate(sketch[a[at : at + 4096]], sketch[b[at : at + 4096]], rule.k)
        j = p / 100
        fine.append(est >= np.where(used < rule.k, j - 1e-9, j - rule.sigmas * (j * (1 - j) / rule.k) ** 0.5))
    return a, b, np.concatenate(fine), forest


def _forest(far: np.ndarray):
    """Prim's algorithm from every part."""
    m = len(far)
    best = np.full(m, np.inf, dtype=np.float32)
    near = np.zeros(m, dtype=np.int64)
    left = np.isfinite(far).any(axis=1)
    a, b = [], []
    now = -1
    for _ in range(int(left.sum())):
        if now >= 0:
            best[now] = np.inf
        cand = np.where(left, best, np.inf)
        k = int(cand.argmin())
        if np.isfinite(cand[k]):
            a.append(int(near[k]))
            b.append(k)
        else:
            k = int(left.argmax())
        left[k] = False
        closer = far[k] < best
        best = np.where(closer, far[k], best)
        near = np.where(closer, k, near)
        now = k
    return np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)


def candidates(grouped: DataFrame, rule: Rule, everything: bool = False) -> DataFrame:
    """(v, i, j, a, b, fine, forest) from the rows of ``blocks``."""
    cols = ["v", "i", "j", "row", "side", "own", "n", "sketch", "parity", "label"]
    parts = max(1, int(grouped.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = grouped.select(*cols).repartition(parts, "v", "i", "j").sortWithinPartitions("v", "i", "j")

    def one(t: pa.Table):
        order = np.argsort(t["row"].to_numpy(), kind="stable")
        t = t.take(pa.array(order))
        row, n = t["row"].to_numpy(), t["n"].to_numpy()
        parity = np.frombuffer(b"".join(t["parity"].to_pylist()), dtype=np.uint64).reshape(len(row), -1)
        lists = t["sketch"].combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        width = min(rule.k, int(sizes.max()))
        sketch = np.full((len(row), width), np.iinfo(np.uint64).max, dtype=np.uint64)
        sketch[np.arange(width)[None, :] < sizes[:, None]] = lists.flatten().to_numpy().view(np.uint64)
        i, j = t["i"][0].as_py(), t["j"][0].as_py()
        side = t["side"].to_numpy() if i != j else None
        label = t["label"].to_numpy()
        before = met_before(t["own"].combine_chunks(), t["v"][0].as_py())
        a, b, fine, forest = compare(n, parity, sketch, side, label, before, rule, everything)
        low, high = np.minimum(row[a], row[b]), np.maximum(row[a], row[b])
        return [t["v"][0].as_py()] * len(a), [i] * len(a), [j] * len(a), low, high, fine, forest

    def run(batches):
        held: list[pa.RecordBatch] = []
        rows: list[list] = [[] for _ in range(7)]

        def flush(t):
            if t.num_rows > 1:
                for out, new in zip(rows, one(t)):
                    out.extend(new)

        for b in batches:
            if not b.num_rows:
                continue
            v, i, j = (b[c].to_numpy() for c in ("v", "i", "j"))
            if held:
                h = held[-1]
                if (h["v"][-1].as_py(), h["i"][-1].as_py(), h["j"][-1].as_py()) != (v[0], i[0], j[0]):
                    flush(pa.Table.from_batches(held))
                    held = []
            cuts = np.flatnonzero((v[1:] != v[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            begin = 0
            for end in cuts.tolist():
                flush(pa.Table.from_batches([*held, b.slice(begin, end - begin)]))
                held, begin = [], end
            held.append(b.slice(begin))
            if len(rows[0]) > 50_000:
                yield rows
                rows[:] = [[] for _ in range(7)]
        if held:
            flush(pa.Table.from_batches(held))
        if rows[0]:
            yield rows

    return _mapped(dealt, run, "v long, i int, j int, a long, b long, fine boolean, forest boolean")


def verified(edges: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """(a, b, linked): exact similarity of the full sets."""
    left = sets.select(F.col("row").alias("a"), F.col("hashes").alias("x"))
    right = sets.select(F.col("row").alias("b"), F.col("hashes").alias("y"))
    values = 0
    if edges.count() > FEW_ROWS:
        degree = edges.groupBy("a").agg(F.count("*").alias("c"))
        hubs = saved(left.join(_small(saved(degree.where(F.col("c") > HUB).select("a"), "hubs")), "a", "left_semi"), "hub_sets")
        values = hubs.agg(F.coalesce(F.sum(F.size("x")), F.lit(0))).first()[0]
    if 0 < values <= BROADCAST_VALUES:
        first = edges.join(right, "b").join(F.broadcast(hubs), "a")
        with_x = edges.join(F.broadcast(hubs.select("a")), "a", "left_anti").join(left, "a").join(right, "b").unionByName(first)
    else:
        with_x = edges.join(left, "a").join(right, "b")
    both = F.size(F.array_intersect("x", "y"))
    return with_x.select(
        "a", "b", (both * 100 >= rule.percent * (F.size("x") + F.size("y") - both)).alias("linked")
    )


def full_sets(documents: DataFrame, wanted: DataFrame, rule: Rule) -> DataFrame:
    """(row, hashes) for ``wanted`` (row, doc_id, th): the whole texts are read again, only for these."""
    texts = _keyed(documents).join(
        _small(wanted.withColumnsRenamed({"doc_id": "_id", "th": "_th"})), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th"))
    )

    def run(batches):
        known: dict[bytes, int] = {}
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                yield part["row"], _lists([shingles(t, rule.size, known) for t in part["text"].to_pylist()])

    found = _mapped(texts.select("row", "text"), run, "row long, hashes array<long>")
    return found.dropDuplicates(["row"])


def _sets_of(pairs: DataFrame, all_: DataFrame, documents: DataFrame, rule: Rule) -> DataFrame:
    ends = saved(pairs.select(F.col("a").alias("row")).union(pairs.select("b")).distinct(), "ends")
    wanted = saved(all_.select("row", "doc_id", "th").join(_small(ends), "row", "left_semi"), "wanted")
    return saved(full_sets(documents, wanted, rule), "sets")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b): root is the smallest node that can be reached."""
    e = saved(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")

    def state(t):
        return t.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    before = state(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("r"), F.count("*").alias("c"))
        large = hot_join(both, low, "a", "c", 2 * before[0]).where("b > a").select(F.col("b").alias("a"), F.col("r").alias("b")).distinct()
        large = saved(large, "large")
        low = large.groupBy("a").agg(F.min("b").alias("r"), F.count("*").alias("c"))
        small = hot_join(large, low, "a", "c", 2 * before[0]).where("b <> r").select(F.col("b").alias("a"), F.col("r").alias("b"))
        step = saved(small.unionByName(low.select("a", F.col("r").alias("b"))).distinct(), "small")
        after = state(step)
        discard(large, e)
        e = step
        if after == before:
            break
        before = after
    nodes = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def groups(documents: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """One row per document: row, doc_id, th (hash of the text), n_shingles, component_id and group (null: no words).

    The result is a saved table; all that it was made from is deleted.
    """
    with tidied():
        return saved(_groups(documents, rule), "groups", keep=True)


def _groups(documents: DataFrame, rule: Rule) -> DataFrame:
    all_ = saved(sketches(documents, rule), "sketches")
    with_words = all_.where("n > 0")
    classes = saved(with_words.groupBy("digest").agg(F.min("row").alias("row"), F.min("doc_id").alias("least_id"), F.count("*").alias("copies")), "classes")
    copies = saved(
        with_words.select("digest", F.col("row").alias("copy")).join(classes.where("copies > 1"), "digest").where("copy <> row").select(F.col("copy").alias("row")),
        "copies",
    )
    reps = with_words.join(_small(copies), "row", "left_anti")
    lists = saved(inverted_lists(reps, rule), "lists")
    tested = parts = None
    if lists.where(F.col("m") > BLOCK).limit(1).count():
        pairs = pivot_pairs(lists, all_.select("row", "n", "sketch"), rule)
        tested = saved(verified(pairs, _sets_of(pairs, all_, documents, rule), rule), "attached")
        parts = saved(components(tested.where("linked")), "parts")
    listed = saved(lists.select("row").distinct(), "listed")
    payload = all_.select("row", "n", "sketch", "parity").join(_small(listed), "row", "left_semi")
    grouped = blocks(lists, payload, parts)
    edges = saved(candidates(grouped, rule), "candidates")
    pairs = edges.where("fine").select("a", "b").distinct()
    pairs = saved(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
    seen = verified(pairs, _sets_of(pairs, all_, documents, rule), rule)
    tested = saved(seen if tested is None else seen.unionByName(tested), "tested")
    roots = saved(components(tested.where("linked")), "roots")

    # blocks in which an edge of the forest failed between parts that are still apart
    link = edges.where("forest").join(tested, ["a", "b"], "left").where(~F.coalesce("linked", F.lit(False)))
    root_of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    apart = link.join(root_of("a"), "a", "left").join(root_of("b"), "b", "left").where(
        F.coalesce("a_root", "a") != F.coalesce("b_root", "b")
    )
    again = saved(apart.select("v", "i", "j").distinct(), "again")
    if again.limit(1).count():
        rows = grouped.drop("label").join(again, ["v", "i", "j"], "left_semi").join(roots.withColumnsRenamed({"node": "row", "root": "label"}), "row", "left")
        rows = rows.withColumn("label", F.coalesce("label", "row"))
        more = candidates(rows, rule, everything=True).where("fine").select("a", "b").distinct()
        more = saved(more.join(tested, ["a", "b"], "left_anti"), "more")
        also = verified(more, _sets_of(more, all_, documents, rule), rule).where("linked")
        roots = saved(components(tested.where("linked").unionByName(also)), "roots")

    named = classes.join(roots.withColumnRenamed("node", "row"), "row", "left").select("digest", "least_id", "copies", F.coalesce("root", "row").alias("root"))
    least = named.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count("*").alias("c"))
    rows = all_.count()
    named = hot_join(named, least, "root", "c", rows).select("digest", "component_id", F.col("root").alias("group"), "copies")
    found = hot_join(all_.where("n > 0"), named, "digest", "copies", rows)
    none = all_.where("n = 0").withColumns({"component_id": F.lit(None).cast("long"), "group": F.lit(None).cast("long")})
    out = found.unionByName(none).withColumnRenamed("n", "n_shingles")
    return out.select(
        "row", "doc_id", "th", "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        "group",
    )


def judged(documents: DataFrame, rule: Rule = Rule(size=3, percent=85)) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (whether the document names its group)."""
    return groups(documents, rule).select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def deduplicated(documents: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """One document of each group, that of the smallest id; documents without words all stay."""
    found = groups(documents, rule).where(F.col("group").isNotNull())
    stays = found.groupBy("group").agg(F.min_by("row", F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("row"))
    first = found.join(stays.select("row"), "row", "left_semi")
    gone = found.join(stays.select("row"), "row", "left_anti").select("doc_id", "th")
    # rows repeated with their id: the key of the one that stays is no reason to drop it
    same = (F.col("doc_id").eqNullSafe(F.col("_id"))) & (F.col("th") == F.col("_th"))
    names = first.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"))
    kept = without(documents, gone.join(names, same, "left_anti"))
    again = saved(found.groupBy("doc_id", "th").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("_id"), F.col("th").alias("_th")), "again")
    if not again.limit(1).count():
        return kept
    columns = kept.columns
    h = unused(kept, "_h")
    kept = kept.withColumn(h, F.xxhash64("text"))
    same = (kept["doc_id"].cast("long").eqNullSafe(again["_id"])) & (kept[h] == again["_th"])
    repeated = kept.join(again, same, "left_semi").dropDuplicates(["doc_id", h])
    return kept.join(again, same, "left_anti").unionByName(repeated).select(*columns)
