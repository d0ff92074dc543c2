"""Registered queries of the pipeline operators, with the DuckDB SQL for the same rows.

Input and output formats are exercised by writing to the shared folder of the session and reading back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import types as kinds
from .functions import combiners
from .functions.text import characters, field, first_tab, solid_length, split_keep_empty, split_words, stamped
from .operators.collection import Collection, Table, flatten
from .operators.map_reduce import MapReduce
from .plans.inspect import operators
from .plans.pipeline import Pipeline
from .plans.shared import combined
from .plans.workflow import Workflow
from .sources import readers, sinks
from .sources.shared import scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def collection(spark: SparkSession, sf_dir: str, name: str, value) -> Collection:
    value = F.col(value) if isinstance(value, str) else value
    return Collection(read(spark, sf_dir, name).select(value.alias("value")))


def table(spark: SparkSession, sf_dir: str, name: str, key, value) -> Table:
    key, value = (F.col(c) if isinstance(c, str) else c for c in (key, value))
    return Table(read(spark, sf_dir, name).select(key.alias("key"), value.alias("value")))


# ------------------------------------------------------------------ words


@query("""
select w as key, count(*) as value from (select unnest(regexp_split_to_array(text, '\\s+')) as w from documents) where w <> '' group by w
""")
def wordcount_documents(spark, sf_dir):
    words = collection(spark, sf_dir, "documents", "text").flat_map(split_words)
    return words.map_pairs(lambda w: (w, F.lit(1))).group_by_key().combine("total").df


@query("""
select w as value, count(*) as n from (select unnest(regexp_split_to_array(replace(text, '. ', '.  '), '\\s')) as w from documents) group by w
""")
def split_keep_empty_parts(spark, sf_dir):
    text = collection(spark, sf_dir, "documents", "text").map(lambda t: F.replace(t, F.lit(". "), F.lit(".  ")))
    return text.flat_map(split_keep_empty).count().df.select(F.col("key").alias("value"), F.col("value").alias("n"))


@query("""
select w as key, cast(count(*) as bigint) as value from (select unnest(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+')) as w from documents) where w <> '' group by w
""")
def wordcount_python_tier(spark, sf_dir):
    words = collection(spark, sf_dir, "documents", "text").parallel_do(lambda t: (w.decode() for w in t.encode().split()) if t else (), kinds.strings())
    return words.count().df


@query("""
select c as key, count(*) as value from (select unnest(string_split(regexp_replace(text, '\\s', '', 'g'), '')) as c from documents) where c <> '' group by c
""")
def char_count(spark, sf_dir):
    letters = collection(spark, sf_dir, "documents", "text").map(lambda t: F.regexp_replace(t, r"\s", "")).flat_map(characters)
    return letters.count().df


@query("select length(regexp_replace(text, '\\s', '', 'g')) as key, count(*) as value from documents group by 1")
def line_length_hist(spark, sf_dir):
    return collection(spark, sf_dir, "documents", "text").map(solid_length).count().df


@query("select len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) as key, count(*) as value from documents group by 1")
def token_count_hist(spark, sf_dir):
    return collection(spark, sf_dir, "documents", "text").map(lambda t: F.size(split_words(t))).count().df


# ------------------------------------------------------------------ element-wise


@query("select o_orderkey || ':' || o_orderstatus as value from orders")
def map_project(spark, sf_dir):
    t = table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus")
    return t.map(lambda k, v: F.concat_ws(":", k.cast("string"), v), kinds.strings()).df


@query("select l_suppkey as key, l_orderkey + l_linenumber as value from lineitem")
def map_rekey(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem", "l_orderkey", F.struct("l_suppkey", "l_linenumber"))
    return t.map_pairs(lambda k, v: (v["l_suppkey"], k + v["l_linenumber"]), kinds.table_of(kinds.longs(), kinds.longs())).df


@query("select l_orderkey as key, l_quantity as value from lineitem where l_quantity >= 45 and l_shipdate >= timestamp '1995-01-01'")
def filter_emit_zero_or_one(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem", "l_orderkey", F.struct("l_quantity", "l_shipdate"))
    kept = t.filter(lambda k, v: (v["l_quantity"] >= 45) & (v["l_shipdate"] >= F.lit("1995-01-01").cast("timestamp_ntz")))
    return kept.map_pairs(lambda k, v: (k, v["l_quantity"])).df


@query("select o_orderkey as value from orders where o_orderkey % 3 = 0 union all select o_orderkey from orders where o_orderkey % 3 = 0")
def python_emit_any_number(spark, sf_dir):
    keys = collection(spark, sf_dir, "orders", "o_orderkey")
    return keys.parallel_do(lambda k: [k, k] if k % 3 == 0 else [], kinds.longs()).df


@query("select l_orderkey as key, l_partkey * 2 as value from lineitem union all select l_orderkey, l_partkey * 3 from lineitem")
def flatmap_two_pairs(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey")
    return t.flat_map_pairs(lambda k, v: [(k, v * 2), (k, v * 3)]).df


@query("select o_orderkey + 1 as plus, (o_orderkey + 1) * 2 as twice, o_orderstatus || '-blah' as tag, '2010/09/13' as day from orders")
def map_chain(spark, sf_dir):
    rows = collection(spark, sf_dir, "orders", F.struct("o_orderkey", "o_orderstatus"))
    day = stamped(F.lit("2010-09-13").cast("date"))
    plus = rows.map(lambda v: F.struct((v["o_orderkey"] + 1).alias("plus"), v["o_orderstatus"].alias("name")))
    return plus.map(lambda v: F.struct(v["plus"].alias("plus"), (v["plus"] * 2).alias("twice"), F.concat(v["name"], F.lit("-blah")).alias("tag"), day.alias("day"))).df.select("value.*")


@query("select distinct event_type || '/' || (user_id % 7) as value from events")
def distinct_elements(spark, sf_dir):
    t = table(spark, sf_dir, "events", "event_type", "user_id")
    return t.map(lambda k, v: F.concat_ws("/", k, (v % 7).cast("string"))).distinct().df


# ------------------------------------------------------------------ grouping


@query("select o_custkey as key, string_agg(o_orderkey, ',' order by o_orderkey) as value from orders group by o_custkey")
def group_by_key_values(spark, sf_dir):
    grouped = table(spark, sf_dir, "orders", "o_custkey", "o_orderkey").group_by_key().values()
    return grouped.map_pairs(lambda k, v: (k, F.array_join(F.array_sort(v).cast("array<string>"), ","))).df


@query("select c_nationkey as key, string_agg(c_name, ',' order by c_acctbal desc, c_name) as value from customer group by c_nationkey")
def group_by_key_sorted_values(spark, sf_dir):
    t = table(spark, sf_dir, "customer", "c_nationkey", F.struct("c_acctbal", "c_name"))
    grouped = t.group_by_key().sorted_values(-F.col("value.c_acctbal"), "value.c_name")
    return grouped.map_pairs(lambda k, v: (k, F.array_join(F.transform(v, lambda x: x["c_name"]), ","))).df


@query("""
select user_id as key, arg_min(event_type, (ts, event_id)) as first_type, arg_max(event_type, (ts, event_id)) as last_type from events group by user_id
""")
def group_by_key_sorted_first_last(spark, sf_dir):
    t = table(spark, sf_dir, "events", "user_id", F.struct("ts", "event_id", "event_type"))
    g = t.group_by_key()
    both = g.aggregate(
        first_type=F.min_by("value.event_type", F.struct("value.ts", "value.event_id")),
        last_type=F.max_by("value.event_type", F.struct("value.ts", "value.event_id")),
    )
    return both.df.select("key", "value.*")


@query("""
select l_suppkey as key, l_orderkey as value from (
  select *, row_number() over (partition by l_suppkey order by l_extendedprice desc, l_orderkey, l_linenumber, l_partkey) as r from lineitem
) where r <= 3
""")
def group_top_three(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem", "l_suppkey", F.struct("l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey"))
    best = t.group_by_key().top(3, F.desc("value.l_extendedprice"), "value.l_orderkey", "value.l_linenumber", "value.l_partkey")
    return best.map_pairs(lambda k, v: (k, v["l_orderkey"])).df


@query("select o_custkey as key, o_orderkey as value from orders")
def group_sorted_rows(spark, sf_dir):
    return table(spark, sf_dir, "orders", "o_custkey", "o_orderkey").group_by_key().sorted_rows("value").df


@query("select l_partkey as key, cast(sum(l_linenumber) as bigint) as value from lineitem group by l_partkey")
def combine_sum(spark, sf_dir):
    return table(spark, sf_dir, "lineitem", "l_partkey", "l_linenumber").group_by_key().combine("total").df


@query("select l_suppkey as key, min(l_quantity) as lowest, max(l_quantity) as highest, count(*) as n from lineitem group by l_suppkey")
def combine_min_max(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem", "l_suppkey", "l_quantity").group_by_key()
    return t.aggregate(lowest=F.min("value"), highest=F.max("value"), n=F.count(F.lit(1))).df.select("key", "value.*")


@query("select l_suppkey as key, cast(bit_xor(l_partkey) as bigint) as value from lineitem group by l_suppkey")
def combine_python_fold(spark, sf_dir):
    def folded(values):
        out = 0
        for v in values:
            out ^= v
        return out

    return table(spark, sf_dir, "lineitem", "l_suppkey", "l_partkey").group_by_key().combine(folded).df


@query("select o_custkey as key, cast(sum(o_orderkey) as bigint) as value from orders group by o_custkey")
def combine_column_fold(spark, sf_dir):
    g = table(spark, sf_dir, "orders", "o_custkey", "o_orderkey").group_by_key()
    return g.fold(F.lit(0).cast("bigint"), lambda acc, v: acc + v).df


@query("select l_returnflag || '=' || cast(sum(l_linenumber) as bigint) as value from lineitem group by l_returnflag")
def combine_then_map(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem", "l_returnflag", "l_linenumber").group_by_key().combine("total")
    return t.map(lambda k, v: F.concat_ws("=", k, v.cast("string"))).df


@query("""
select n as key, count(*) as value from (select o_custkey, count(*) as n from orders group by o_custkey) group by n
""")
def combine_then_group(spark, sf_dir):
    per = table(spark, sf_dir, "orders", "o_custkey", "o_orderkey").group_by_key().combine("count")
    return per.map_pairs(lambda k, v: (v, k)).group_by_key().combine("count").df


@query("""
select c_mktsegment as key, cast(sum(n) as bigint) as value
from (select o_custkey, count(*) as n from orders group by o_custkey) o join customer on c_custkey = o_custkey group by c_mktsegment
""")
def two_sequential_groupings(spark, sf_dir):
    per = table(spark, sf_dir, "orders", "o_custkey", "o_orderkey").group_by_key().combine("count")
    segments = table(spark, sf_dir, "customer", "c_custkey", "c_mktsegment")
    return per.join(segments).inner().map_pairs(lambda k, v: (v["right"], v["left"])).group_by_key().combine("total").df


@query("""
with a as (select l_orderkey, count(*) as n from lineitem group by l_orderkey),
b as (select o_custkey, sum(n) as n from a join orders on o_orderkey = l_orderkey group by o_custkey)
select c_nationkey as key, cast(sum(n) as bigint) as value from b join customer on c_custkey = o_custkey group by c_nationkey
""")
def three_step_chain(spark, sf_dir):
    swap = lambda k, v: (v["right"], v["left"])
    a = table(spark, sf_dir, "lineitem", "l_orderkey", F.lit(1)).group_by_key().combine("count")
    b = a.join(table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")).inner().map_pairs(swap).group_by_key().combine("total")
    c = b.join(table(spark, sf_dir, "customer", "c_custkey", "c_nationkey")).inner().map_pairs(swap).group_by_key().combine("total")
    return c.df


@query("select l_shipdate as key, count(*) as value from lineitem group by l_shipdate")
def count_elements(spark, sf_dir):
    return collection(spark, sf_dir, "lineitem", "l_shipdate").count().df


@query("select l_returnflag as flag, l_linestatus as status, count(*) as n from lineitem group by 1, 2")
def count_pairs(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem", "l_returnflag", "l_linestatus").count().df
    return t.select(F.col("key.key").alias("flag"), F.col("key.value").alias("status"), F.col("value").alias("n"))


@query("select distinct user_id as value from events")
def distinct_keys(spark, sf_dir):
    return table(spark, sf_dir, "events", "user_id", "event_type").group_by_key().keys().df


@query("select o_orderpriority as key, 1 as value from orders group by o_orderpriority")
def constant_combiner(spark, sf_dir):
    return table(spark, sf_dir, "orders", "o_orderpriority", "o_orderkey").group_by_key().combine(combiners.constant(1)).df


@query("""
select 'priority' as channel, o_orderpriority as key, count(*) as value from orders group by 2
union all select 'status', o_orderstatus, count(*) from orders group by 2
union all select 'year', cast(year(o_orderdate) as varchar), count(*) from orders group by 2
""")
def multi_groupby_shared_scan(spark, sf_dir):
    one = F.lit(1).cast("bigint")
    orders = read(spark, sf_dir, "orders")
    return combined(orders, F.sum, priority=(F.col("o_orderpriority"), one), status=(F.col("o_orderstatus"), one), year=(F.year("o_orderdate"), one))


# ------------------------------------------------------------------ flatten


@query("select c_nationkey as value from customer union all select s_nationkey from supplier")
def flatten_union_all(spark, sf_dir):
    return flatten(collection(spark, sf_dir, "customer", "c_nationkey"), collection(spark, sf_dir, "supplier", "s_nationkey")).df


@query("""
select c_nationkey as key, count(*) as value from (
  select c_nationkey from customer union all select s_nationkey from supplier union all select n_nationkey from nation union all select n_nationkey from nation
) group by c_nationkey
""")
def flatten_nested(spark, sf_dir):
    n = collection(spark, sf_dir, "nation", "n_nationkey")
    inner = flatten(flatten(collection(spark, sf_dir, "customer", "c_nationkey")), collection(spark, sf_dir, "supplier", "s_nationkey"))
    return flatten(inner, flatten(n, n)).count().df


@query("select c_nationkey + 1 as value from customer where c_nationkey + 1 > 10 union all select s_nationkey + 1 from supplier where s_nationkey + 1 > 10")
def flatten_then_map(spark, sf_dir):
    both = flatten(collection(spark, sf_dir, "customer", "c_nationkey"), collection(spark, sf_dir, "supplier", "s_nationkey"))
    return both.map(lambda v: v + 1).filter(lambda v: v > 10).df


@query("""
select k as key, cast(sum(cents) as bigint) as value from (
  select c_nationkey as k, cast(round(c_acctbal * 100) as bigint) as cents from customer union all select s_nationkey, cast(round(s_acctbal * 100) as bigint) from supplier
) group by k
""")
def flatten_then_group(spark, sf_dir):
    cents = lambda c: F.round(F.col(c) * 100).cast("bigint")
    a = table(spark, sf_dir, "customer", "c_nationkey", cents("c_acctbal"))
    b = table(spark, sf_dir, "supplier", "s_nationkey", cents("s_acctbal"))
    return a.flatten(b).group_by_key().combine("total").df


@query("""
select 'bypass' as channel, n_name || '-blah' as key, n_name || '-bloh' as value from nation
union all select 'group', n_name, 'foo' from (select r_name as n_name from region union all select n_name from nation) group by n_name
""")
def flatten_bypass_and_group(spark, sf_dir):
    names, regions = collection(spark, sf_dir, "nation", "n_name"), collection(spark, sf_dir, "region", "r_name")
    bypass = names.map_pairs(lambda v: (F.concat(v, F.lit("-blah")), F.concat(v, F.lit("-bloh"))))
    grouped = flatten(regions, names).map_pairs(lambda v: (v, F.lit("foo"))).group_by_key().combine("smallest")
    return bypass.df.select(F.lit("bypass").alias("channel"), "key", "value").unionByName(grouped.df.select(F.lit("group").alias("channel"), "key", "value"))


# ------------------------------------------------------------------ co-group and joins


@query("""
with a as (select o_orderkey as k, count(*) as n from orders where o_orderkey % 2 = 1 group by 1), b as (select l_orderkey as k, count(*) as n from lineitem where l_orderkey % 3 <> 0 group by 1)
select coalesce(a.k, b.k) as key, coalesce(a.n, 0) as left_n, coalesce(b.n, 0) as right_n from a full join b on a.k = b.k
""")
def cogroup_sizes(spark, sf_dir):
    a = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey").filter(lambda k, v: k % 2 == 1)
    b = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey").filter(lambda k, v: k % 3 != 0)
    return a.join(b).sizes().df.select("key", F.col("value.left").alias("left_n"), F.col("value.right").alias("right_n"))


@query("""
with a as (select c_custkey % 500 as k, string_agg(c_name, ',' order by c_name) as t from customer group by 1), b as (select s_suppkey % 700 as k, string_agg(s_name, ',' order by s_name) as t from supplier group by 1)
select coalesce(a.k, b.k) as key, coalesce(a.t, '') as left_t, coalesce(b.t, '') as right_t from a full join b on a.k = b.k
""")
def cogroup_values(spark, sf_dir):
    a, b = table(spark, sf_dir, "customer", F.col("c_custkey") % 500, "c_name"), table(spark, sf_dir, "supplier", F.col("s_suppkey") % 700, "s_name")
    show = lambda c: F.array_join(F.array_sort(F.col(f"value.{c}")), ",").alias(f"{c}_t")
    return a.join(b).values().df.select("key", show("left"), show("right"))


@query("""
with a as (select nullif(o_orderkey % 7, 0) as k, count(*) as n from orders group by 1), b as (select nullif(c_custkey % 9, 0) as k, count(*) as n from customer group by 1)
select coalesce(a.k, b.k) as key, coalesce(a.n, 0) as left_n, coalesce(b.n, 0) as right_n from a full join b on a.k is not distinct from b.k
""")
def cogroup_null_keys(spark, sf_dir):
    a = table(spark, sf_dir, "orders", F.nullif(F.col("o_orderkey") % 7, F.lit(0)), "o_custkey")
    b = table(spark, sf_dir, "customer", F.nullif(F.col("c_custkey") % 9, F.lit(0)), "c_nationkey")
    return a.join(b).sizes().df.select("key", F.col("value.left").alias("left_n"), F.col("value.right").alias("right_n"))


def _sides(spark, sf_dir, left, right):
    return table(spark, sf_dir, *left).join(table(spark, sf_dir, *right))


_ORDERS, _LINES = ("orders", "o_orderkey", "o_custkey"), ("lineitem", "l_orderkey", "l_partkey")
_DOCS, _LABELS = ("documents", "doc_id", "lang"), ("labels", "doc_id", "quality")
_CUSTOMERS, _EVENTS = ("customer", "c_custkey", "c_nationkey"), ("events", "user_id", "event_id")


def _flat(t: Table) -> DataFrame:
    return t.df.select("key", "value.*")


@query("select o_orderkey as key, o_custkey as left, l_partkey as right from orders join lineitem on o_orderkey = l_orderkey")
def join_inner(spark, sf_dir):
    return _flat(_sides(spark, sf_dir, _ORDERS, _LINES).inner())


@query("select d.doc_id as key, lang as left, quality as right from documents d left join labels l on d.doc_id = l.doc_id")
def join_left(spark, sf_dir):
    return _flat(_sides(spark, sf_dir, _DOCS, _LABELS).left_outer())


@query("select user_id as key, c_nationkey as left, event_id as right from customer right join events on c_custkey = user_id")
def join_right(spark, sf_dir):
    return _flat(_sides(spark, sf_dir, _CUSTOMERS, _EVENTS).right_outer())


@query("select coalesce(c_custkey, user_id) as key, c_nationkey as left, event_id as right from customer full join events on c_custkey = user_id")
def join_full(spark, sf_dir):
    return _flat(_sides(spark, sf_dir, _CUSTOMERS, _EVENTS).full_outer())


@query("select o_orderkey as key, o_custkey as value from orders where o_orderkey in (select l_orderkey from lineitem)")
def join_semi(spark, sf_dir):
    return _sides(spark, sf_dir, _ORDERS, _LINES).semi().df


@query("select o_orderkey as key, o_custkey as value from orders where o_orderkey not in (select l_orderkey from lineitem)")
def join_anti(spark, sf_dir):
    return _sides(spark, sf_dir, _ORDERS, _LINES).anti().df


# ------------------------------------------------------------------ text fields


@query("""
select event_type || '|' || (user_id % 5) as key, count(*) as value from events group by 1
""")
def composite_key_group(spark, sf_dir):
    line = F.concat_ws("\t", "event_type", F.col("event_id").cast("string"), (F.col("user_id") % 5).cast("string"))
    lines = collection(spark, sf_dir, "events", line)
    return lines.map_pairs(lambda v: (F.concat_ws("|", field(v, 0), field(v, 2)), F.lit(1))).group_by_key().combine("count").df


@query("""
select case when event_id % 3 = 0 then event_type else event_type end as key,
  case when event_id % 3 = 0 then '' when event_id % 3 = 1 then cast(user_id as varchar) else user_id || chr(9) || event_id end as value from events
""")
def tab_kv_parse(spark, sf_dir):
    third = F.col("event_id") % 3
    line = F.concat(
        F.col("event_type"),
        F.when(third == 0, "").when(third == 1, F.concat_ws("", F.lit("\t"), F.col("user_id").cast("string"))).otherwise(F.concat(F.lit("\t"), F.concat_ws("\t", F.col("user_id").cast("string"), F.col("event_id").cast("string")))),
    )
    return collection(spark, sf_dir, "events", line).map_pairs(first_tab).df


# ------------------------------------------------------------------ map-reduce, formats, workflows


@query("select l_returnflag as key, cast(sum(l_linenumber) as bigint) as value from lineitem group by 1")
def toy_map_reduce(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem", "l_returnflag", F.col("l_linenumber").cast("bigint"))
    schema = kinds.table_of(kinds.strings(), kinds.longs())
    return MapReduce().map(lambda k, v: [(k, v)], schema).combine(sum).reduce(lambda k, vs: [(k, sum(vs))], schema).run(t).df


@query("select l_orderkey as key, l_partkey + 1 as value from lineitem")
def toy_map_only(spark, sf_dir):
    schema = kinds.table_of(kinds.longs(), kinds.longs())
    return MapReduce().map(lambda k, v: [(k, v + 1)], schema).run(table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey")).df


@query("select l_returnflag as key, cast(sum(l_linenumber) as bigint) as value from lineitem group by 1")
def toy_reduce_uncombined(spark, sf_dir):
    """A third of the rows has one key: the reducer reads each group as a stream."""
    t = table(spark, sf_dir, "lineitem", "l_returnflag", F.col("l_linenumber").cast("bigint"))
    schema = kinds.table_of(kinds.strings(), kinds.longs())
    return MapReduce().map(lambda k, v: [(k, v)], schema).reduce(lambda k, vs: [(k, sum(vs))], schema).run(t).df


@query("select n_name as key, cast(1 << n_nationkey as bigint) as value from nation where n_nationkey < 15")
def toy_reduce_powers(spark, sf_dir):
    """The k-th name stands 2^k times under other keys and is counted without a combiner."""
    nations = table(spark, sf_dir, "nation", "n_nationkey", "n_name").filter(lambda k, v: k < 15)
    copies = nations.flat_map(lambda k, v: F.array_repeat(v, F.pow(F.lit(2), k).cast("int")))
    schema = kinds.table_of(kinds.strings(), kinds.longs())
    job = MapReduce().map(lambda k, v: [(v, 1)], schema).reduce(lambda k, vs: [(k, sum(vs))], schema)
    return job.run(copies.map_pairs(lambda v: (F.length(v), v))).df


@query("""
select o_custkey as key, o_orderkey as value from orders qualify row_number() over (partition by o_custkey order by o_orderkey) <= 2
""")
def grouped_python_reduce(spark, sf_dir):
    """A reducer may leave the rest of a group unread."""
    g = table(spark, sf_dir, "orders", "o_custkey", "o_orderkey")
    least = g.group_by_key().sorted_values().map_pairs(lambda k, v: (k, F.slice(v, 1, 3)))
    pairs = least.flat_map_pairs(lambda k, v: [(k, F.get(v, i)) for i in range(3)]).filter(lambda k, v: v.isNotNull())

    def two(key, values):
        return [(key, v) for v in sorted(values)[:2]]

    return pairs.group_by_key().reduce(two, kinds.table_of(kinds.longs(), kinds.longs())).df


@query("select o_custkey as key, round(max(o_totalprice) - min(o_totalprice), 2) as value from orders group by o_custkey")
def grouped_apply(spark, sf_dir):
    def spread(frame):
        import pandas as pd

        return pd.DataFrame({"key": frame["key"].head(1), "value": round(frame["value"].max() - frame["value"].min(), 2)})

    return table(spark, sf_dir, "orders", "o_custkey", "o_totalprice").group_by_key().apply(spread, kinds.table_of(kinds.longs(), kinds.doubles())).df


@query("""
with a as (select c_nationkey as k, count(*) as n from customer group by 1), b as (select s_nationkey as k, count(*) as n from supplier group by 1)
select coalesce(a.k, b.k) as key, coalesce(a.n, 0) * 1000 + coalesce(b.n, 0) as value from a full join b on a.k = b.k
""")
def cogrouped_apply(spark, sf_dir):
    def sizes(left, right):
        import pandas as pd

        key = left["key"].iloc[0] if len(left) else right["key"].iloc[0]
        return pd.DataFrame({"key": [key], "value": [len(left) * 1000 + len(right)]})

    a, b = table(spark, sf_dir, "customer", "c_nationkey", "c_custkey"), table(spark, sf_dir, "supplier", "s_nationkey", "s_suppkey")
    return a.join(b).apply(sizes, kinds.table_of(kinds.integers(), kinds.longs())).df


@query("select user_id as key, arg_min(event_type, (ts, event_id)) as first_type, arg_max(event_type, (ts, event_id)) as last_type from events group by user_id")
def group_first_last(spark, sf_dir):
    g = table(spark, sf_dir, "events", "user_id", F.struct("ts", "event_id", "event_type")).group_by_key()
    order = ("value.ts", "value.event_id")
    both = g.first(*order).join(g.last(*order)).inner().df
    return both.select("key", F.col("value.left.event_type").alias("first_type"), F.col("value.right.event_type").alias("last_type"))


@query("select o_custkey as key, string_agg(distinct o_orderpriority, ';' order by o_orderpriority) as value from orders group by o_custkey")
def combine_joined_text(spark, sf_dir):
    t = table(spark, sf_dir, "orders", "o_custkey", "o_orderpriority").distinct()
    return t.group_by_key().combine(combiners.joined_text(";")).df


@query("select c_custkey as key, c_name as value from customer")
def seqfile_roundtrip(spark, sf_dir):
    path = scratch(spark, "pairs.seq")
    t = table(spark, sf_dir, "customer", "c_custkey", "c_name")
    sinks.sequence_file(t, path)
    return readers.sequence_file(spark, path, t.schema).df


@query("select nullif(o_orderkey % 4, 0) as key, nullif(o_clerk, 'Open') as value from (select o_orderkey, case o_orderstatus when 'O' then 'Open' else o_orderstatus end as o_clerk from orders)")
def seqfile_nulls(spark, sf_dir):
    path = scratch(spark, "nulls.seq")
    t = table(spark, sf_dir, "orders", F.nullif(F.col("o_orderkey") % 4, F.lit(0)), F.nullif("o_orderstatus", F.lit("O")))
    sinks.sequence_file(t, path, nulls=True)
    return readers.sequence_file(spark, path, t.schema).df


@query("select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority from orders")
def avro_roundtrip(spark, sf_dir):
    path = scratch(spark, "orders.avro")
    sinks.avro(Collection(read(spark, sf_dir, "orders").select(F.struct("*").alias("value"))), path)
    return readers.avro_file(spark, path).df.select("value.*")


@query("select event_type as key, cast(user_id as varchar) as value from events")
def text_roundtrip(spark, sf_dir):
    path = scratch(spark, "events.txt")
    sinks.text(table(spark, sf_dir, "events", "event_type", "user_id"), path)
    return readers.declared(spark, path, kinds.table_of(kinds.strings(), kinds.strings())).df


@query("select o_orderkey || ' ' || o_orderpriority as value from orders union all select '' from region")
def text_lines(spark, sf_dir):
    path = scratch(spark, "lines.txt")
    lines = collection(spark, sf_dir, "orders", F.concat_ws(" ", F.col("o_orderkey").cast("string"), "o_orderpriority"))
    sinks.text(flatten(lines, collection(spark, sf_dir, "region", F.lit(""))), path)
    return Pipeline(spark).read_text_file(path).df


@query("select 'customers' as origin, c_name as value from customer union all select 'suppliers', s_name from supplier")
def text_of_several_inputs(spark, sf_dir):
    at = {n: scratch(spark, n) for n in ("customers", "suppliers")}
    sinks.text(collection(spark, sf_dir, "customer", "c_name"), at["customers"])
    sinks.text(collection(spark, sf_dir, "supplier", "s_name"), at["suppliers"])
    lines = readers.text_with_origin(spark, *at.values())
    return lines.df.select(F.element_at(F.split("key", "/"), -2).alias("origin"), "value")


@query("""
select w as key, count(*) as value from (select unnest(string_split('the mill turns while the water runs water wears the stone the stone grinds the grain', ' ')) as w) group by w
union all select 'lines', 4
""")
def resource_words(spark, sf_dir):
    lines = Pipeline(spark).read_resource_file("millrace.resources", "mill.txt")
    return lines.flat_map(split_words).count().df.unionByName(lines.map(lambda v: F.lit("lines")).count().df)


@query("select s_suppkey as value, 2 as n from supplier")
def avro_read_twice(spark, sf_dir):
    path = scratch(spark, "keys.avro")
    sinks.avro(collection(spark, sf_dir, "supplier", "s_suppkey"), path)
    keys = readers.avro_file(spark, path)
    return flatten(keys, keys).count().df.select(F.col("key").alias("value"), F.col("value").alias("n"))


@query("select o_orderpriority as priority, cast(o_custkey as double) as customer, 'new' as note from orders")
def avro_reader_schema(spark, sf_dir):
    """Projection, an alias, a wider type and a default, all while decoding."""
    path = scratch(spark, "orders.avro")
    sinks.avro(Collection(read(spark, sf_dir, "orders").select(F.struct("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate").alias("value"))), path)
    fields = [
        {"name": "priority", "aliases": ["o_orderpriority"], "type": ["null", "string"]},
        {"name": "customer", "aliases": ["o_custkey"], "type": ["null", "double"]},
        {"name": "note", "type": "string", "default": "new"},
    ]
    return readers.avro_file(spark, path, {"type": "record", "name": "Order", "fields": fields}).df.select("value.*")


@query("select l_orderkey, l_shipdate, cast(l_extendedprice as decimal(12, 2)) as price from lineitem")
def avro_logical_types(spark, sf_dir):
    path = scratch(spark, "lines.avro")
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate", F.col("l_extendedprice").cast("decimal(12, 2)").alias("price"))
    sinks.avro(Collection(lines.select(F.struct("*").alias("value"))), path)
    return readers.avro_file(spark, path).df.select("value.*")


@query("select i as value, 'row' as kind from range(1000) t(i) union all select i * i, 'pair' from range(100) t(i) union all select -1, 'more' from range(3)")
def rows_in_memory(spark, sf_dir):
    p = Pipeline(spark)
    rows = p.from_rows(range(1000), kinds.longs())
    pairs = p.from_pairs([(i, i * i) for i in range(100)], kinds.table_of(kinds.longs(), kinds.longs()))
    kind = lambda bag, name: bag.df.select("value", F.lit(name).alias("kind"))
    more = p.from_rows([-1], kinds.longs()).append([-1, -1])
    return kind(rows, "row").unionByName(kind(pairs.values(), "pair")).unionByName(kind(more, "more"))


@query("select c_custkey as value from customer union all select 0 union all select 0")
def append_rows(spark, sf_dir):
    return collection(spark, sf_dir, "customer", "c_custkey").append([0, 0]).df


@query("select n_name || '!' as value, 'iterated' as how from nation union all select n_name, 'collected' from nation")
def iterate_and_collect(spark, sf_dir):
    """Small results on the driver, one after the other or all at once."""
    p = Pipeline(spark)
    names = collection(spark, sf_dir, "nation", "n_name")
    one = p.from_rows([f"{x}!" for x in names], kinds.strings()).df.withColumn("how", F.lit("iterated"))
    return one.unionByName(p.from_rows(names.collect(), kinds.strings()).df.withColumn("how", F.lit("collected")))


@query("select 'fused maps' as plan, 0 as exchanges union all select 'co-group', 1 union all select 'three groupings', 1")
def plan_shapes(spark, sf_dir):
    """Exchanges of physical plans: adjacent maps have none, a co-group and groupings of one input share one."""
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    maps = orders.map_pairs(lambda k, v: (v, k)).filter(lambda k, v: v > 3).map(lambda k, v: k + v).df
    both = orders.join(table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey")).values().df
    plans = {"fused maps": maps, "co-group": both, "three groupings": multi_groupby_shared_scan(spark, sf_dir)}
    rows = [(name, operators(df)["Exchange"]) for name, df in plans.items()]
    return spark.createDataFrame(rows, "plan string, exchanges int")


class Segments(Workflow):
    """Orders by status and by priority, from one expensive parent."""

    def __init__(self, spark, sf_dir):
        super().__init__(spark)
        self.sf_dir = sf_dir

    def build(self):
        orders = self.input("orders", table(self.pipeline.spark, self.sf_dir, "orders", F.struct("o_orderstatus", "o_orderpriority"), F.lit(1)))
        both = orders.group_by_key().combine("count")
        self.output("status", both.map_pairs(lambda k, v: (k["o_orderstatus"], v)).group_by_key().combine("total"))
        self.output("priority", both.map_pairs(lambda k, v: (k["o_orderpriority"], v)).group_by_key().combine("total"))


@query("""
select 'status' as output, o_orderstatus as key, count(*) as value from orders group by 2 union all select 'priority', o_orderpriority, count(*) from orders group by 2
""")
def workflow_multi_output(spark, sf_dir):
    where = Segments(spark, sf_dir).run(scratch(spark, "segments"))
    parts = [spark.read.parquet(p).select(F.lit(n).alias("output"), "key", "value") for n, p in where.items()]
    return parts[0].unionByName(parts[1])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordcount_documents(spark, sf_dir)
