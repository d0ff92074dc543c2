"""Elements, pairs and grouping on literal rows."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace import types as kinds
from millrace.functions import combiners
from millrace.functions.text import first_tab, split_keep_empty, split_words
from millrace.operators.collection import flatten
from millrace.operators.map_reduce import MapReduce
from millrace.plans.inspect import operators, plan_text
from millrace.plans.pipeline import Pipeline

LINES = ["the mill turns", "the water runs the mill", "Mill stones grind grain", "grain grain"]
INT_PAIRS = kinds.table_of(kinds.integers(), kinds.integers())


@pytest.fixture(scope="module")
def p(spark):
    return Pipeline(spark)


def ints(p, *values):
    return p.from_rows(values, kinds.integers())


def pairs(p, *values):
    return p.from_pairs(values, INT_PAIRS)


def bag(c):
    return Counter(c.collect())


def test_word_count(p):
    words = p.from_rows(LINES, kinds.strings()).flat_map(split_words)
    counted = dict(words.map_pairs(lambda w: (w, F.lit(1))).group_by_key().combine("total").collect())
    assert counted == {"the": 3, "mill": 2, "turns": 1, "water": 1, "runs": 1, "Mill": 1, "stones": 1, "grind": 1, "grain": 3}
    assert dict(words.count().collect()) == counted


def test_maps_fuse_and_keep_their_results(p):
    one = ints(p, 1, 2, 3)
    plus = one.map(lambda v: v + 1)
    assert bag(plus) == Counter([2, 3, 4])
    both = plus.map(lambda v: v * 2)
    assert bag(both) == Counter([4, 6, 8])
    assert bag(one.map(lambda v: v * 2)) == Counter([2, 4, 6])
    assert operators(both.df)["Project"] <= 1


def test_flatten(p):
    a, b, c = ints(p, 1, 2, 3), ints(p, 4, 5, 6), ints(p, 7, 8, 9)
    assert bag(flatten(a, b)) == Counter(range(1, 7))
    assert bag(flatten(flatten(a, b), c)) == bag(flatten(c, flatten(b, a))) == Counter(range(1, 10))
    assert bag(flatten(a)) == Counter([1, 2, 3])
    assert bag(flatten(a, b).map(lambda v: v + 1)) == Counter(range(2, 8))
    assert bag(flatten(a, a)) == Counter([1, 1, 2, 2, 3, 3])
    with pytest.raises(TypeError):
        flatten(a, p.from_rows(["x"], kinds.strings()))
    with pytest.raises(ValueError):
        flatten()


def test_counts_of_overlapping_ranges(p):
    counts = dict(flatten(ints(p, *range(10)), ints(p, *range(5, 15))).count().collect())
    assert counts == {v: 2 if 5 <= v < 10 else 1 for v in range(15)}


def test_group_and_combine(p):
    t = ints(p, 1, 2, 3).flat_map_pairs(lambda v: [(v, v * 2), (v, v * 3)])
    assert {k: sorted(v) for k, v in t.group_by_key().values().collect()} == {1: [2, 3], 2: [4, 6], 3: [6, 9]}
    assert dict(t.group_by_key().combine("total").collect()) == {1: 5, 2: 10, 3: 15}
    assert dict(t.group_by_key().combine(sum).collect()) == {1: 5, 2: 10, 3: 15}


def test_nulls_nan_and_duplicates(p):
    t = pairs(p, (1, None), (1, 2), (None, 3), (None, 4), (1, 2))
    grouped = {k: Counter(v) for k, v in t.group_by_key().values().collect()}
    assert grouped == {1: Counter([None, 2, 2]), None: Counter([3, 4])}
    assert dict(t.group_by_key().combine("count").collect()) == {1: 3, None: 2}
    assert Counter({(k.key, k.value): n for k, n in t.count().collect()}) == Counter({(1, None): 1, (1, 2): 2, (None, 3): 1, (None, 4): 1})
    d = p.from_pairs([(math.nan, 1), (math.nan, 2), (0.0, 3), (-0.0, 4)], kinds.table_of(kinds.doubles(), kinds.integers()))
    for fold in ("total", sum):
        got = {str(k) if k != k else abs(k): v for k, v in d.group_by_key().combine(fold).collect()}
        assert got == {"nan": 3, 0.0: 7}


def test_python_fold_is_called_for_single_values(p):
    t = pairs(p, (1, 5), (2, 6), (2, 7))
    assert dict(t.group_by_key().combine(lambda values: [*values] and 1).collect()) == {1: 1, 2: 1}
    assert dict(t.group_by_key().combine(combiners.constant(1)).collect()) == {1: 1, 2: 1}


def test_empty_inputs(p):
    t = pairs(p)
    assert t.group_by_key().values().collect() == []
    assert t.group_by_key().combine(sum).collect() == []
    assert t.count().collect() == []
    assert t.join(t).values().collect() == []
    assert t.parallel_do(lambda k, v: [1], kinds.integers()).collect() == []


def test_ordered_groups(p):
    schema = kinds.table_of(kinds.strings(), kinds.pairs_of(kinds.strings(), kinds.strings()))
    log = [("north", ("09:40", "c")), ("south", ("08:30", "e")), ("north", ("07:05", "a")), ("south", ("08:10", "d")), ("north", ("08:55", "b"))]
    g = p.from_pairs(log, schema).group_by_key()
    times = {k: [x.key for x in v] for k, v in g.sorted_values("value.key").collect()}
    assert times == {"north": ["07:05", "08:55", "09:40"], "south": ["08:10", "08:30"]}
    assert {k: v.value for k, v in g.first("value.key").collect()} == {"north": "a", "south": "d"}
    assert {k: v.value for k, v in g.last("value.key").collect()} == {"north": "c", "south": "e"}
    assert [(k, v.value) for k, v in g.sorted_rows("value.key", global_order=True).collect()] == [("north", "a"), ("north", "b"), ("north", "c"), ("south", "d"), ("south", "e")]
    assert Counter(k for k, _ in g.top(2, "value.key").collect()) == Counter(north=2, south=2)
    assert "WindowGroupLimit" in plan_text(g.top(2, "value.key").df)


def test_first_per_key(p):
    t = flatten(pairs(p, (1, 1), (1, 2), (1, 3)), pairs(p, (2, 10), (2, 20), (3, 30)))
    assert dict(t.group_by_key().first("value").collect()) == {1: 1, 2: 10, 3: 30}


def test_two_groupings_in_a_row(p):
    t = p.from_rows(LINES, kinds.strings()).map_pairs(lambda v: (v, F.lit("foo"))).group_by_key().combine("count")
    again = t.map_pairs(lambda k, v: (k, F.lit("bar "))).group_by_key().combine("smallest")
    out = again.map_pairs(lambda k, v: (k, F.concat(v, F.lit("2")))).collect()
    assert sorted(out) == sorted((x, "bar 2") for x in LINES)


def test_cogroup(p):
    a, b = pairs(p, (1, 10), (1, 10), (2, None), (None, 5)), pairs(p, (2, 7), (3, 8), (None, 6))
    got = {k: (sorted(v.left, key=str), sorted(v.right, key=str)) for k, v in a.join(b).values().collect()}
    assert got == {1: ([10, 10], []), 2: ([None], [7]), 3: ([], [8]), None: ([5], [6])}
    assert {k: tuple(v) for k, v in a.join(b).sizes().collect()} == {1: (2, 0), 2: (1, 1), 3: (0, 1), None: (1, 1)}
    assert operators(a.join(b).values().df)["Exchange"] <= 1
    assert Counter(a.join(b).semi().collect()) == Counter([(2, None), (None, 5)])
    assert Counter(a.join(b).anti().collect()) == Counter([(1, 10), (1, 10)])
    assert Counter((k, tuple(v)) for k, v in a.join(b).full_outer().collect()) == Counter(
        [(1, (10, None)), (1, (10, None)), (2, (None, 7)), (3, (None, 8)), (None, (5, 6))]
    )
    with pytest.raises(TypeError):
        a.join(p.from_pairs([("x", 1)], kinds.table_of(kinds.strings(), kinds.integers())))


def test_built_in_combiners_have_a_partial_phase(p):
    plan = plan_text(pairs(p, (1, 1)).group_by_key().combine("total").df)
    assert "partial_sum" in plan


def test_python_tier_agrees_with_columns(p):
    words = p.from_rows(LINES, kinds.strings())
    assert bag(words.parallel_do(lambda t: t.split(), kinds.strings())) == bag(words.flat_map(split_words))
    t = pairs(p, (1, 2), (3, 4)).parallel_do_pairs(lambda k, v: [(v, k), (k, v)], INT_PAIRS)
    assert bag(t) == Counter([(2, 1), (1, 2), (4, 3), (3, 4)])
    with pytest.raises(Exception):
        words.parallel_do(lambda t: 1 / 0, kinds.strings()).collect()


def test_declared_types_are_checked(p):
    c = ints(p, 1)
    assert c.map(lambda v: v.cast("string"), kinds.strings()).collect() == ["1"]
    with pytest.raises(TypeError):
        c.map(lambda v: v.cast("string"), kinds.integers())


def test_splits(p):
    c = p.from_rows(["a  b ", "", " x"], kinds.strings())
    assert sorted(map(tuple, c.map(split_keep_empty).collect())) == [("",), ("", "x"), ("a", "", "b", "")]
    assert sorted(map(tuple, c.map(split_words).collect())) == [(), ("a", "b"), ("x",)]
    lines = p.from_rows(["k", "k\tv", "k\tv\tw", "\tv", ""], kinds.strings())
    assert bag(lines.map_pairs(first_tab)) == Counter([("k", ""), ("k", "v"), ("k", "v\tw"), ("", "v"), ("", "")])


def test_map_reduce(p):
    out_schema = kinds.table_of(kinds.integers(), kinds.longs())
    letters = p.from_pairs([(k % 3, c) for k, c in enumerate("abcdefghij") for _ in range(2**k)], kinds.table_of(kinds.integers(), kinds.strings()))
    counted = kinds.table_of(kinds.strings(), kinds.longs())
    job = MapReduce().map(lambda k, c: [(c, 1)], counted)
    want = {c: 2**k for k, c in enumerate("abcdefghij")}
    assert dict(job.reduce(lambda k, vs: [(k, sum(vs))], counted).run(letters).collect()) == want
    assert dict(job.combine(sum).reduce(lambda k, vs: [(k, sum(vs))], counted).run(letters).collect()) == want
    plus = MapReduce().map(lambda k, v: [(k, v + 1)], out_schema)
    assert sorted(v for _, v in plus.run(pairs(p, (9, 1), (9, 2), (8, 3), (7, 4))).collect()) == [2, 3, 4, 5]


def test_reducers_stream_their_groups(p, spark):
    """Any group size, any amount left unread, nulls and NaN as keys."""
    schema = kinds.table_of(kinds.doubles(), kinds.longs())
    pairs_ = [(math.nan, 1), (None, 2), (0.0, 3), (-0.0, 4), (None, 5), (math.nan, 6), (1.5, 7)]
    t = p.from_pairs(pairs_, schema)
    got = {str(k): v for k, v in t.group_by_key().reduce(lambda k, vs: [(k, sum(vs))], schema).collect()}
    assert {k.replace("-0.0", "0.0"): v for k, v in got.items()} == {"nan": 7, "None": 7, "0.0": 7, "1.5": 7}
    big = p.table(spark.range(300_000).selectExpr("if(id % 3 = 0, id % 50, -1L) as k", "id as v"))
    longs = kinds.table_of(kinds.longs(), kinds.longs())
    n = dict(big.group_by_key().reduce(lambda k, vs: [(k, sum(1 for _ in vs))], longs).collect())
    assert n[-1] == 200_000 and sum(n.values()) == 300_000
    first = big.group_by_key().reduce(lambda k, vs: [(k, int(next(vs) >= 0))], longs).collect()
    assert Counter(first) == Counter((k, 1) for k in n)
    assert big.group_by_key().reduce(lambda k, vs: [], longs).collect() == []
    many = big.group_by_key().reduce(lambda k, vs: ((k, v) for v in vs), longs)
    assert many.df.count() == 300_000


def test_frequent_keys_travel_as_lists(p, spark):
    """Rows that a reducer's tasks sort: lists of values, cut by number and bytes, for keys and values of any type."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    from millrace.operators.python_tier import PACKED, PACKED_BYTES, lists_in, packed

    listed = to_arrow_schema(kinds.table_of(kinds.longs(), kinds.lists_of(kinds.strings())))
    batch = pa.RecordBatch.from_pydict({"key": [None, 7] * 2000, "value": ["x"] * 4000})
    (out,) = packed([batch], listed)
    assert out.num_rows == 2 * -(-2000 // PACKED)
    assert Counter((k, v) for k, vs in lists_in([out]) for v in vs) == {(None, "x"): 2000, (7, "x"): 2000}
    long = pa.RecordBatch.from_pydict({"key": [7] * 9, "value": ["x" * PACKED_BYTES] * 9})
    assert next(packed([long], listed)).num_rows == 9
    assert list(packed([batch.slice(0, 0)], listed)) == []

    hot = p.table(spark.range(60_000).selectExpr("named_struct('a', if(id % 3 = 0, double('nan'), null), 'b', array(id % 2)) as k", "map(id, null) as v"))
    counted = kinds.table_of(hot.schema["key"].dataType, kinds.longs())
    got = hot.group_by_key().reduce(lambda k, vs: [(k, sum(next(iter(dict(v).items()))[0] for v in vs))], counted)
    want = Counter()
    for i in range(60_000):
        want[i % 3 == 0, i % 2] += i
    assert sorted(v for _, v in got.collect()) == sorted(want.values())
    times = p.table(spark.range(10).selectExpr("timestamp_seconds(id % 2) as k", "if(id = 3, null, timestamp_seconds(id)) as v"))
    last = times.group_by_key().reduce(lambda k, vs: [(k, max(v for v in vs if v))], times.schema)
    assert sorted(r[1] for r in last.df.selectExpr("key", "unix_seconds(value)").collect()) == [8, 9]


def test_folds_are_batched(p, spark):
    """One call folds many values of a key."""
    calls = spark.sparkContext.accumulator(0)

    def counted(values):
        calls.add(1)
        return sum(values)

    t = p.table(spark.range(50_000).selectExpr("id % 5 as k", "1L as v"))
    assert dict(t.group_by_key().combine(counted).collect()) == dict.fromkeys(range(5), 10_000)
    assert calls.value < 1000


def test_apply(p):
    import pandas as pd

    t = pairs(p, (1, 2), (1, 5), (2, 7))
    total = t.group_by_key().apply(lambda f: pd.DataFrame({"key": f["key"].head(1), "value": f["value"].sum()}), INT_PAIRS)
    assert dict(total.collect()) == {1: 7, 2: 7}
    sizes = lambda a, b: pd.DataFrame({"key": [max(a["key"].max(), b["key"].max()) if len(a) and len(b) else (a if len(a) else b)["key"].iloc[0]], "value": [len(a) * 10 + len(b)]})
    assert dict(t.join(pairs(p, (2, 0), (3, 0))).apply(sizes, INT_PAIRS).collect()) == {1: 20, 2: 11, 3: 1}
    assert dict(t.group_by_key().combine(combiners.joined_text("-")).collect()) == {1: "2-5", 2: "7"}


#: key, value: nulls, NaN and zeros as keys, values whose frames differ by group, an hour that comes twice
FRAMED = [
    ("if(id % 3 = 0, null, id % 7)", "if(id % 7 = 2, null, id + (1L << 60) + 1)"),
    ("if(id % 2 = 0, null, double('nan'))", "if(id % 2 = 0, null, id % 3 = 0)"),
    ("if(id % 2 = 0, 0d, -0d)", "cast(id as tinyint)"),
    ("if(id % 5 = 0, null, id % 2 = 0)", "if(id % 5 = 0, null, float(id))"),
    ("named_struct('a', if(id % 2 = 0, null, double('nan')), 'b', array(id % 2))", "array(id, if(id % 3 = 1, null, id))"),
    ("timestamp_seconds(1604208600 + 3600 * (id % 2))", "if(id % 2 = 0, null, timestamp_seconds(id))"),
    ("concat('k', id % 3)", "named_struct('x', id, 'y', if(id % 3 = 1, null, id))"),
    ("date_add(date'2020-01-01', cast(id % 3 as int))", "cast(id as decimal(20, 2))"),
    ("cast(concat(id % 3) as binary)", "if(id % 3 = 0, null, cast(id as string))"),
    ("1", "id"),
]


@pytest.mark.parametrize("key, value", FRAMED)
def test_frames_of_groups(p, spark, key, value):
    """Frames are those that Spark makes of each group alone, also where groups share batches or span several."""
    import pandas as pd

    def shown(f):
        first = f["key"].iloc[:1]
        said = f"{list(f.columns)} {list(f.index)[:2]} {list(f.dtypes)} {first.tolist()!r} {sorted(map(repr, f['value'].tolist()))} {type(f['value'].iloc[0])}"
        return pd.DataFrame({"key": [said.replace("-0.0", "0.0")], "value": [len(f)]})

    schema = kinds.table_of(kinds.strings(), kinds.longs())
    df = spark.range(0, 100, 1, 3).selectExpr(f"{key} as key", f"{value} as value")
    conf = {"spark.sql.execution.arrow.maxRecordsPerBatch": "7", "spark.sql.session.timeZone": "America/New_York"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        want = Counter(map(tuple, df.groupBy("key").applyInPandas(shown, schema).collect()))
        assert Counter(p.table(df).group_by_key().apply(shown, schema).collect()) == want
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_apply_over_many_groups(p, spark):
    """What a group returns: by name, by position, nothing, exact integers beside nulls; one frame of Spark for many groups."""
    import pandas as pd

    longs = kinds.table_of(kinds.longs(), kinds.longs())
    t = p.table(spark.range(40_000).selectExpr("id div 4 as key", "id as value"))

    def some(f):
        k = int(f["key"].iloc[0])
        if k % 5 == 0:
            return pd.DataFrame() if k % 2 else f.iloc[:0]
        if k % 5 == 1:
            return pd.DataFrame([[k, 2**60 + k]])
        if k % 5 == 2:
            return pd.DataFrame({"value": [float("nan")], "key": [k]})
        return f[["value", "key"]].tail(2)

    got = Counter(t.group_by_key().apply(some, longs).collect())
    want = Counter((k, 2**60 + k) for k in range(1, 10_000, 5)) + Counter((k, None) for k in range(2, 10_000, 5))
    assert got == want + Counter((k, v) for k in range(10_000) if k % 5 > 2 for v in (4 * k + 2, 4 * k + 3))
    for bad in (lambda f: f.rename(columns={"value": "other"}), lambda f: f[["key"]], lambda f: 1):
        with pytest.raises(Exception, match="a function of groups returned"):
            t.group_by_key().apply(bad, longs).collect()
    assert t.filter(lambda k, v: k < 0).group_by_key().apply(some, longs).collect() == []
    assert "FlatMapGroupsInPandas" not in plan_text(t.group_by_key().apply(some, longs).df)


def test_apply_over_a_stream(p, spark, tmp_path):
    import pandas as pd

    spark.range(10).selectExpr("id % 3 as key", "id as value").write.parquet(f"{tmp_path}/in")
    longs = kinds.table_of(kinds.longs(), kinds.longs())
    t = p.table(spark.readStream.schema(longs).parquet(f"{tmp_path}/in"))
    total = t.group_by_key().apply(lambda f: pd.DataFrame({"key": f["key"].head(1), "value": f["value"].sum()}), longs)
    total.df.writeStream.format("memory").queryName("applied").outputMode("append").trigger(availableNow=True).start().awaitTermination(60)
    assert sorted(map(tuple, spark.table("applied").collect())) == [(0, 18), (1, 12), (2, 15)]


def test_hot_key(p, spark):
    t = p.table(spark.range(100_000).selectExpr("if(id % 10 = 0, id, -1L) as k", "1L as v"))
    assert dict(t.group_by_key().combine(sum).collect())[-1] == 90_000
    assert dict(t.group_by_key().combine("total").collect())[-1] == 90_000


def test_append_and_iteration(p):
    c = ints(p, 1).append([2, 2])
    assert sorted(c) == [1, 2, 2]
    assert ints(p, 1).collect() == [1]
