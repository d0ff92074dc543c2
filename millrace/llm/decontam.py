"""Benchmark decontamination by winnowing, with DataFrame functions only.

Words are lower-cased (A-Z) alphanumeric runs. For items of at least ``WINDOW`` words the span is WINDOW, for
shorter ones the whole item. Fingerprints of a span of L words: k-grams of k = (L + 1) / 2 words are hashed and
of each window of L - k + 1 consecutive hashes the smallest is kept. A window covers exactly L words, so two
texts that share L words in a row share the fingerprint of those words: no shared span is missed. Neighbouring
windows mostly keep the same hash, and such a run is one row (about 2 / (L - k + 2) of the words, and fewer where a
text repeats itself). Rows are joined with the distinct hashes of the benchmark. A row that meets one is extended:
each span of words that its windows cover is compared with the spans of the items, word for word, so hits are exact
whatever the hashes do. Rows grow with the length of the texts, never with the product of a text and an item.

The spans of the benchmark and their hashes are broadcast up to ``BROADCAST_ROWS``, which are counted first: then one pass over the documents tokenises them and
hands on their numbers of words and the words around hits, nothing else. Beyond it the rows are joined by a shuffle
(adaptive execution splits hot hashes) and the documents that are hit are read again.

Null and empty texts have no words; very long texts are taken whole. Repeated documents each get their row; identical
rows share one computation. Rows of an item that has no words match nothing; null item ids count for hits, but are not
listed among the items. An item id on several rows is one item. Without documents there is no row, without items no hit.
Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import only, saved, tidied, without

WINDOW = 13
#: spans of words of the benchmark that are broadcast at most (up to about 150 bytes each)
BROADCAST_ROWS = 500_000
#: windows that a row of equal neighbouring hashes stands for at most
RUN = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: str) -> Column:
    """Lower-cased words of a text. ``lower`` serves where all is ASCII; elsewhere only A-Z may change."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    low = F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))
    return F.array_remove(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _sliding(df: DataFrame, name: str, length: Column, n: int, join: Callable[[Column, Column], Column]) -> tuple[DataFrame, Column]:
    """Replaces array ``name`` by ``join`` over each ``n`` neighbours, doubling the reach at each step."""
    reach = 1
    while reach < n:
        step = min(reach, n - reach)
        left = F.greatest(length - step, F.lit(0))
        a = F.col(name)
        df = df.withColumn(name, F.zip_with(F.slice(a, F.lit(1), left), F.slice(a, F.lit(step + 1), left), join))
        length = left
        reach += step
    return df, length


def marks(df: DataFrame, span: int, name: str) -> DataFrame:
    """Adds array ``name`` to (…, words): for each window of ``span`` words its smallest k-gram hash."""
    k = (span + 1) // 2
    df = df.withColumn(name, F.transform("words", lambda w: F.xxhash64(w)))
    df, left = _sliding(df, name, F.size("words"), k, lambda a, b: F.xxhash64(a, b))
    df, _ = _sliding(df, name, left, span - k + 1, lambda a, b: F.least(a, b))
    return df


def fingerprints(df: DataFrame, spans: list[int]) -> DataFrame:
    """(…, words) with one row for each run of windows that keep the same hash: (…, words, n_words, span, at, mark).

    ``at`` is the first window of the run. Each input row has, besides, one row without mark.
    """
    keys = df.columns
    parts = []
    for span in spans:
        df = marks(df, span, f"_m{span}")
        before = F.concat(F.array(F.lit(None).cast("long")), F.col(f"_m{span}"))
        first = F.zip_with(f"_m{span}", before, lambda a, b: F.when(~a.eqNullSafe(b), a))
        df = df.withColumn(f"_f{span}", first)
        parts.append(F.struct(F.lit(span).alias("span"), F.col(f"_f{span}").alias("first"), F.col(f"_m{span}").alias("all")))
    df = df.withColumn("n_words", F.size("words").cast("long"))
    if len(spans) == 1:
        one = df.select(*keys, "n_words", F.lit(spans[0]).alias("span"), F.col(f"_f{spans[0]}").alias("first"), F.col(f"_m{spans[0]}").alias("all"))
    else:
        one = df.select(*keys, "n_words", F.inline_outer(F.array(*parts)))
    # the outer form: a plain explode makes Catalyst infer a filter that computes all the arrays a second time
    rows = one.select(*keys, "n_words", "span", "all", F.posexplode_outer("first").alias("at", "mark"))
    rows = rows.withColumn("mark", F.when((F.col("at") % RUN == 0) & F.col("mark").isNull(), F.get("all", F.col("at"))).otherwise(F.col("mark")))
    head = (F.col("span") == spans[0]) & F.coalesce(F.col("at") == 0, F.lit(True))
    return rows.drop("all").withColumn("head", head).where("head or mark is not null")


def windows(df: DataFrame) -> DataFrame:
    """(…, start, span, content) of every span of words in ``near``, of which the first starts at ``at``."""
    keys = [c for c in df.columns if c not in ("near", "at", "span")]
    each = df.select(*keys, "at", "span", "near", F.explode(F.sequence(F.lit(0), F.size("near") - F.col("span"))).alias("o"))
    content = F.array_join(F.slice("near", F.col("o") + 1, F.col("span")), " ")
    return each.select(*keys, (F.col("at") + F.col("o")).alias("start"), "span", content.alias("content"))


def _near(words: Column) -> Column:
    return F.slice(words, F.col("at") + 1, F.col("span") + (RUN - 1))


def touched(docs: DataFrame, own: DataFrame, spans: list[int], small: bool) -> tuple[DataFrame, DataFrame]:
    """(doc_id, th, n_words) of every document; (doc_id, th, at, span, near) of the runs whose hash is in ``own``.

    small: ``own`` may be broadcast.
    """
    key = ["span", "mark"]
    if small:
        known = F.broadcast(own.withColumn("met", F.lit(True)))
        rows = fingerprints(docs, spans).join(known, key, "left").where("head or met")
        near = F.when(F.col("met"), _near(F.col("words")))
        rows = saved(rows.select("doc_id", "th", "n_words", "head", "at", "span", near.alias("near")), "runs")
        return rows.where("head").select("doc_id", "th", "n_words"), rows.where("near is not null").drop("head", "n_words")
    heads = docs.select("doc_id", "th", F.size("words").cast("long").alias("n_words"))
    rows = fingerprints(docs, spans).select("doc_id", "th", "span", "at", "mark").where("mark is not null")
    hits = saved(rows.join(own, key, "left_semi").select("doc_id", "th", "span", "at").distinct(), "runs")
    texts = only(docs.select("doc_id", "th", "words"), hits.select("doc_id", "th")).withColumnsRenamed({"doc_id": "_id", "th": "_th"})
    both = hits.join(texts, hits["doc_id"].eqNullSafe(texts["_id"]) & (hits["th"] == texts["_th"]))
    return heads, both.select("doc_id", "th", "at", "span", _near(F.col("words")).alias("near"))


def prepared(benchmark: DataFrame) -> DataFrame:
    """The saved items that have words: (item_id, span, words)."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words("text").alias("words"))
    items = items.where(F.size("words") > 0).withColumn("span", F.least(F.size("words"), F.lit(WINDOW)))
    return saved(items.distinct(), "items")


def matched(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, th, n_words) of every document of (doc_id, th, words); (doc_id, th, n_hit, items, full) of those hit.

    full: whether a window of WINDOW words is hit, not only short items.
    """
    n = items.groupBy("span").agg(F.sum(F.size("words") - F.col("span") + 1).alias("n")).collect()  # WINDOW rows at most
    spans = sorted(r["span"] for r in n)
    small = sum(r["n"] for r in n) <= BROADCAST_ROWS
    if not spans:
        heads = docs.select("doc_id", "th", F.size("words").cast("long").alias("n_words"))
        none = heads.limit(0).select("doc_id", "th", F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"), F.lit(False).alias("full"))
        return heads, none
    own = reduce(
        DataFrame.unionByName,
        (marks(items.where(F.col("span") == s), s, "m").select("span", F.explode_outer("m").alias("mark")) for s in spans),
    )
    keep = (lambda df, name: df) if small else saved
    own = keep(own.distinct(), "marks")
    owners = keep(windows(items.select("item_id", F.lit(0).alias("at"), "span", F.col("words").alias("near"))).drop("start").distinct(), "owners")
    contents = keep(owners.select("span", "content").distinct(), "contents")
    heads, runs = touched(docs, own, spans, small)
    found = windows(runs).distinct()
    found = saved(found.join(F.broadcast(contents) if small else contents, ["span", "content"], "left_semi"), "found")
    earlier = Window.partitionBy("doc_id", "th").orderBy("start", "span").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("span")
    covered = found.select("doc_id", "th", "start", "span").distinct().withColumn("done", F.coalesce(F.max(end).over(earlier), F.lit(0)))
    hit = covered.groupBy("doc_id", "th").agg(
        F.sum(F.greatest(end - F.greatest("start", "done"), F.lit(0))).cast("long").alias("n_hit"), F.max(F.col("span") == WINDOW).alias("full")
    )
    named = found.select("doc_id", "th", "span", "content").distinct().join(owners.where("item_id is not null"), ["span", "content"])
    named = named.select("doc_id", "th", "item_id").distinct().groupBy("doc_id", "th").agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    named = named.withColumnsRenamed({"doc_id": "_id", "th": "_th"})
    hit = hit.join(named, hit["doc_id"].eqNullSafe(named["_id"]) & (hit["th"] == named["_th"]), "left")
    return heads, hit.select("doc_id", "th", "n_hit", "items", "full")


def _docs(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), words("text").alias("words"))


def contamination(documents: DataFrame, benchmark: DataFrame, how: str = "left") -> DataFrame:
    """One row per document: doc_id, th (hash of the text), n_words, n_hit, items, full, contaminated.

    With ``how="inner"`` only documents that are hit (all others are not contaminated). The result is a saved table.
    """
    with tidied():
        return saved(_contamination(documents, benchmark, how), "contamination", keep=True)


def _contamination(documents: DataFrame, benchmark: DataFrame, how: str) -> DataFrame:
    heads, hit = matched(_docs(documents), prepared(benchmark))
    hit = hit.withColumnsRenamed({"doc_id": "_id", "th": "_th"})
    both = heads.join(hit, heads["doc_id"].eqNullSafe(hit["_id"]) & (heads["th"] == hit["_th"]), how)
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return both.select(
        "doc_id",
        "th",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("full", F.lit(False)).alias("full"),
        ((n_hit > 0) & (n_hit * 20 >= F.col("n_words"))).alias("contaminated"),
    )


def decontaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without those that share WINDOW words in a row with an item, however long they are.

    Items of fewer words are weak evidence (one of them may be a single word): their hits drop a document where they
    make up a twentieth of its words.
    """
    found = contamination(documents, benchmark, how="inner")
    return without(documents, found.where("full or contaminated").select("doc_id", "th"))


def judged(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = contamination(documents, benchmark)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


_WORDS = "list_filter(string_split_regex(translate(coalesce(text, ''), '{u}', '{l}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')".format(u=UPPER, l=LOWER)

SQL = f"""
with d as (
  select row_number() over () as r, doc_id, {_WORDS} as w from documents
), b as (
  select cast(item_id as varchar) as item_id, {_WORDS} as w from benchmark
), bw as (
  select distinct item_id, least({WINDOW}, len(w)) as span, array_to_string(w[i : i + least({WINDOW}, len(w)) - 1], ' ') as g
  from b, unnest(range(1, len(w) - least({WINDOW}, len(w)) + 2)) as t(i) where len(w) > 0
), dw as (
  select r, i, span, array_to_string(w[i : i + span - 1], ' ') as g
  from d, (select distinct span from bw) s, unnest(range(1, len(w) - span + 2)) as t(i)
), hit as (
  select r, i, span, item_id from dw join bw using (span, g)
), n as (
  select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + span)) as p from hit) group by r
), its as (
  select r, list_sort(list_distinct(list(item_id))) as items from hit group by r
)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, len(coalesce(items, [])) as n_items,
  sha256(array_to_string(coalesce(items, []), ',')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join n using (r) left join its using (r)
"""
