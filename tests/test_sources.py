"""Files written and read back; Avro encoding; workflows; streams."""

import dataclasses
import math
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace import types as kinds
from millrace.operators.collection import Collection, Table
from millrace.plans.pipeline import Pipeline
from millrace.plans.workflow import Workflow, publish, shared_parents
from millrace.sources import avro, readers, seqfile, sinks
from millrace.streaming import streams

PAIRS = kinds.table_of(kinds.integers(), kinds.integers())


@pytest.fixture
def at(tmp_path):
    return lambda name: f"file://{tmp_path}/{name}"


def test_text_and_pairs(spark, at):
    p = Pipeline(spark)
    lines = p.from_rows(["a", "", "é\tx"], kinds.strings())
    sinks.text(lines, at("lines"))
    assert Counter(p.read_text_file(at("lines")).collect()) == Counter(["a", "", "é\tx"])
    t = p.from_pairs([(1, 2), (None, 3)], PAIRS)
    sinks.text(t, at("pairs"))
    assert Counter(p.read_tab_pairs(at("pairs")).collect()) == Counter([("1", "2"), ("", "3")])
    origins = readers.text_with_origin(spark, at("lines"), at("pairs")).collect()
    assert len(origins) == 5 and {k.split("/")[-2] for k, _ in origins} == {"lines", "pairs"}
    with pytest.raises(Exception):
        sinks.text(t, at("pairs"))


def test_sequence_file(spark, at):
    p = Pipeline(spark)
    t = p.from_pairs([(1, 2), (3, 4)], PAIRS)
    p.write_sequence_file(at("seq"), t)
    back = p.read_file(at("seq"), PAIRS).map_pairs(lambda k, v: (k + 1, v + 1))
    assert [(k, v) for k, v in back.group_by_key().sorted_rows(global_order=True).collect()] == [(2, 3), (4, 5)]


def test_sequence_file_types(spark, at):
    """Every Writable, nulls and bytes included; the JVM reads what is written, and the other way round."""
    p = Pipeline(spark)
    cases = [
        (kinds.booleans(), [True, False]),
        (kinds.doubles(), [0.5, math.inf, -0.0]),
        (kinds.floats(), [0.25, -1.0]),
        (kinds.integers(), [0, -(2**31), 2**31 - 1]),
        (kinds.longs(), [2**62, -1]),
        (kinds.strings(), ["", "é\n\t", "x" * 70_000]),
        (kinds.byte_strings(), [b"", b"\0\xff" * 100]),
    ]
    for k, (kind, values) in enumerate(cases):
        schema = kinds.table_of(kind, kinds.longs())
        rows = [(v, i) for i, v in enumerate(values)]
        t = p.from_pairs(rows, schema)
        sinks.sequence_file(t, at(f"plain{k}"))
        shown = lambda got: Counter((bytes(a) if isinstance(a, bytearray) else a, b) for a, b in got)
        assert shown(readers.sequence_file(spark, at(f"plain{k}"), schema).collect()) == shown(rows)
        assert shown(spark.sparkContext.sequenceFile(at(f"plain{k}")).collect()) == shown(rows)
        if kind not in (kinds.floats(), kinds.longs()):  # Python numbers have other Writables there
            spark.sparkContext.parallelize(rows, 2).saveAsSequenceFile(at(f"jvm{k}"))
            got = readers.sequence_file(spark, at(f"jvm{k}"), kinds.table_of(kind, kinds.longs())).collect()
            assert shown(got) == shown(rows)
        sinks.sequence_file(p.from_pairs([*rows, (None, 9)], schema), at(f"nulls{k}"), nulls=True)
        assert shown(readers.sequence_file(spark, at(f"nulls{k}"), schema).collect()) == shown([*rows, (None, 9)])
    with pytest.raises(Exception, match="no Writable"):
        sinks.sequence_file(p.from_pairs([(None, 1)], PAIRS), at("null"))
    with pytest.raises(Exception, match="no Writable"):
        sinks.sequence_file(p.from_pairs([([1], 1)], kinds.table_of(kinds.lists_of(kinds.longs()), kinds.longs())), at("list"))


@pytest.mark.parametrize("codec", ["org.apache.hadoop.io.compress.DefaultCodec", "org.apache.hadoop.io.compress.BZip2Codec", None])
def test_sequence_file_ranges(spark, at, codec):
    rows = [(k, f"value {k} " * 5) for k in range(30_000)]
    spark.sparkContext.parallelize(rows, 2).saveAsSequenceFile(at("jvm"), compressionCodecClass=codec)
    schema = kinds.table_of(kinds.integers(), kinds.strings())
    spark.dataSource.register(seqfile.SequenceSource)
    got = spark.read.format("millrace_sequence").schema(schema).option("range", 20_000).load(at("jvm")).collect()
    assert Counter(map(tuple, got)) == Counter(rows)
    if codec is None:
        t = Table(spark.createDataFrame(rows, schema).coalesce(1))
        sinks.sequence_file(t, at("own"))
        got = spark.read.format("millrace_sequence").schema(schema).option("range", 70_000).load(at("own"))
        assert got.rdd.getNumPartitions() > 5 and Counter(map(tuple, got.collect())) == Counter(rows)


def test_variable_length_numbers():
    for n in (0, 1, 127, 128, -1, -112, -113, 255, 256, 2**31, 2**62, -(2**62)):
        raw = seqfile.vint(n)
        assert seqfile.read_vint(raw) == (n, len(raw))


def test_declared_formats(spark, at):
    p = Pipeline(spark)
    sinks.text(p.from_rows(["x\ty"], kinds.strings()), at("t"))
    assert p.read_file(at("t"), kinds.collection_of(kinds.strings())).collect() == ["x\ty"]
    assert p.read_file(at("t"), kinds.table_of(kinds.strings(), kinds.strings())).collect() == [("x", "y")]
    sinks.parquet(p.from_rows([1.5], kinds.doubles()), at("d"))
    assert p.read_file(at("d"), kinds.collection_of(kinds.doubles())).collect() == [1.5]


def test_resource(spark):
    assert len(Pipeline(spark).read_resource_file("millrace", "types.py").collect()) > 50


SCHEMA = {
    "type": "record",
    "name": "R",
    "fields": [
        {"name": "i", "type": "int"},
        {"name": "l", "type": ["null", "long"]},
        {"name": "d", "type": "double"},
        {"name": "f", "type": "float"},
        {"name": "b", "type": "boolean"},
        {"name": "s", "type": "string"},
        {"name": "r", "type": "bytes"},
        {"name": "a", "type": {"type": "array", "items": "string"}},
        {"name": "m", "type": {"type": "map", "values": "long"}},
    ],
}


@pytest.mark.parametrize("codec", ["null", "deflate"])
def test_avro_values(codec):
    rows = [
        {"i": -5, "l": None, "d": 1.5, "f": 0.25, "b": True, "s": "é", "r": b"\0\1", "a": ["x", ""], "m": [("k", 2**40)]},
        {"i": 2**31 - 1, "l": -(2**63), "d": -0.0, "f": 1.0, "b": False, "s": "", "r": b"", "a": [], "m": []},
    ]
    assert avro.loads(avro.dumps(rows, SCHEMA, codec)) == rows
    assert avro.loads(avro.dumps([], SCHEMA, codec)) == []
    raw = avro.dumps(rows, SCHEMA, codec)
    with pytest.raises(ValueError):
        avro.loads(b"nope" + raw)
    with pytest.raises(ValueError):
        avro.loads(raw[:-1] + bytes([raw[-1] ^ 1]))


def test_avro_files(spark, at):
    p = Pipeline(spark)
    numbers = p.from_rows([float(3 * k) for k in range(10)], kinds.doubles())
    p.write_avro_file(at("doubles"), numbers)
    assert sorted(p.read_avro_file(at("doubles")).collect()) == [3.0 * k for k in range(10)]
    words = p.from_rows(["to and fro", None, "a b"], kinds.strings())
    p.write_avro_file(at("words"), words)
    assert Counter(p.read_avro_file(at("words"), kinds.strings()).collect()) == Counter(["to and fro", None, "a b"])
    records = Collection(spark.range(5000).select(F.struct(F.col("id"), F.col("id").cast("string").alias("t"), F.array("id").alias("a")).alias("value")))
    sinks.avro(records, at("records"))
    assert p.read_avro_file(at("records")).df.select("value.*").orderBy("id").first() == Row(id=0, t="0", a=[0])
    small = spark.read.format("millrace_avro").option("range", 1000).load(at("records"))
    assert small.count() == small.select("id").distinct().count() == 5000
    t = p.from_pairs([(1, None)], PAIRS)
    sinks.avro(t, at("table"))
    assert isinstance(p.read_avro_file(at("table")), Table)
    assert p.read_avro_file(at("table"), PAIRS).collect() == [(1, None)]


@dataclasses.dataclass
class Event:
    name: str
    at: int
    score: float | None
    tags: list[str]


def test_types():
    kind = kinds.records_of(Event)
    assert kind.simpleString() == "struct<name:string,at:bigint,score:double,tags:array<string>>"
    for t in (kind, kinds.pairs_of(kinds.strings(), kinds.byte_strings()), kinds.lists_of(kinds.floats()), T.MapType(T.StringType(), T.IntegerType())):
        assert kinds.from_avro(kinds.to_avro(t)).simpleString() == t.simpleString()
    for t in (T.DateType(), T.TimestampType(), T.TimestampNTZType(), T.DecimalType(12, 3)):
        assert kinds.from_avro(kinds.to_avro(t)) == t
    assert kinds.from_avro(["int", "null", "long"]) == T.LongType() and kinds.from_avro(["float", "double"]) == T.DoubleType()
    assert kinds.from_avro(["int", "string"]).simpleString() == "struct<member0:int,member1:string>"
    with pytest.raises(TypeError):
        kinds.to_avro(T.DayTimeIntervalType())
    with pytest.raises(TypeError):
        kinds.from_avro({"type": "record", "name": "N", "fields": [{"name": "next", "type": ["null", "N"]}]})
    with pytest.raises(TypeError):
        kinds.from_avro("Unknown")


WIDE = {
    "type": "record",
    "name": "W",
    "namespace": "n",
    "fields": [
        {"name": "e", "type": {"type": "enum", "name": "E", "symbols": ["A", "B"]}},
        {"name": "again", "type": "E"},
        {"name": "x", "type": {"type": "fixed", "name": "X", "size": 2}},
        {"name": "u", "type": ["null", "int", "string"]},
        {"name": "day", "type": {"type": "int", "logicalType": "date"}},
        {"name": "at", "type": {"type": "long", "logicalType": "timestamp-micros"}},
        {"name": "price", "type": {"type": "bytes", "logicalType": "decimal", "precision": 20, "scale": 2}},
    ],
}


def test_avro_named_and_logical_types(spark, at):
    p = Pipeline(spark)
    kind = kinds.from_avro(WIDE)
    rows = spark.sql(
        "select 'A' as e, 'B' as again, X'0102' as x, named_struct('member0', cast(null as int), 'member1', 't') as u, date'1969-12-31' as day, "
        "timestamp'2020-02-02 03:04:05.678901' as at, cast(-1234567890123.45 as decimal(20, 2)) as price "
        "union all select 'B', 'A', X'ffff', null, date'2024-01-01', timestamp'1960-01-01 00:00:00', cast(0 as decimal(20, 2))"
    )
    sinks.avro(Collection(rows.select(F.struct("*").alias("value"))), at("wide"), schema=WIDE)
    back = p.read_avro_file(at("wide")).df.select("value.*")
    assert back.schema.simpleString() == kind.simpleString()
    assert sorted(map(str, back.collect())) == sorted(map(str, rows.collect()))
    with pytest.raises(Exception):
        sinks.avro(Collection(rows.select(F.struct(F.lit("C").alias("e")).alias("value"))), at("bad"), schema={"type": "record", "name": "R", "fields": WIDE["fields"][:1]})


def test_avro_reader_schemas(spark, at, tmp_path):
    """Fields are taken by name, numbers are widened, what a file lacks has its default; files may differ."""
    p = Pipeline(spark)
    one = Collection(spark.range(3).select(F.struct(F.col("id").cast("int").alias("a"), F.lit("x").alias("b"), F.array("id").alias("c")).alias("value")))
    two = Collection(spark.range(3, 5).select(F.struct((F.col("id") * 2**40).alias("a"), F.lit(1.5).alias("d")).alias("value")))
    sinks.avro(one, at("mixed"))
    sinks.avro(two, at("other"))
    for f in (tmp_path / "other").glob("*.avro"):
        f.rename(tmp_path / "mixed" / f.name)
    kind = T.StructType([T.StructField("d", T.DoubleType()), T.StructField("a", T.LongType())])
    got = Counter(tuple(r) for r in p.read_avro_file(at("mixed"), kind).collect())
    assert got == Counter([(None, 0), (None, 1), (None, 2), (1.5, 3 * 2**40), (1.5, 4 * 2**40)])
    schema = {"type": "record", "name": "R", "fields": [{"name": "number", "aliases": ["a"], "type": ["null", "double"]}, {"name": "b", "type": "string", "default": "none"}, {"name": "r", "type": "bytes", "default": "\u00ff"}]}
    got = Counter((r.number, r.b, bytes(r.r)) for r in p.read_avro_file(at("mixed"), schema).collect())
    assert got == Counter([(float(k), "x", b"\xff") for k in range(3)] + [(float(k * 2**40), "none", b"\xff") for k in (3, 4)])
    with pytest.raises(Exception):
        p.read_avro_file(at("mixed"), {"type": "record", "name": "R", "fields": [{"name": "a", "type": "string"}]}).collect()
    with pytest.raises(Exception):
        p.read_avro_file(at("mixed"), {"type": "record", "name": "R", "fields": [{"name": "new", "type": "string"}]}).collect()


def _columns(n):
    """Arrow columns with the Avro types that they are written as."""
    import pyarrow as pa

    longs = [0, -1, 63, 64, -64, -65, 2**31, -(2**62), 2**63 - 1, -(2**63)] * n
    dec = [Decimal(x).scaleb(-2) for x in (0, 127, -128, 128, -129, 255, 2**31, -(2**55), 10**17, -(10**18) + 1)] * n
    wide = [Decimal(x) for x in (10**30, -(10**30), -(2**63), 2**63, 2**63 - 1, 0, 1, -1, 255, 256)] * n
    texts = ["", "a", "é" * 70, "x" * 300, "\0", "𝄞", "b", "cc", " ", "y" * 64] * n
    number = lambda p, s: {"type": "bytes", "logicalType": "decimal", "precision": p, "scale": s}
    logical = lambda base, name: {"type": base, "logicalType": name}
    return {
        "l": (pa.array(longs), "long"),
        "i": (pa.array([x % 2**31 - 2**30 for x in longs], pa.int32()), "int"),
        "y": (pa.array([x % 256 - 128 for x in longs], pa.int8()), "int"),
        "b": (pa.array([x % 3 == 0 for x in longs]), "boolean"),
        "f": (pa.array([float(x) for x in longs], pa.float32()), "float"),
        "d": (pa.array([-0.0, float("inf"), 1.5, -2.25, 1e300, 0.1, 3.0, -1.0, 7.0, 9.5] * n), "double"),
        "s": (pa.array(texts), "string"),
        "r": (pa.array([t.encode() for t in texts]), "bytes"),
        "day": (pa.array([x % 40_000 - 20_000 for x in longs], pa.int32()).cast(pa.date32()), logical("int", "date")),
        "at": (pa.array([x % 2**50 - 2**49 for x in longs], pa.timestamp("us", "UTC")), logical("long", "timestamp-micros")),
        "local": (pa.array([x % 2**50 - 2**49 for x in longs], pa.timestamp("us")), logical("long", "local-timestamp-micros")),
        "millis": (pa.array([(x % 2**40 - 2**39) * 1000 for x in longs], pa.timestamp("us", "UTC")), logical("long", "timestamp-millis")),
        "price": (pa.array(dec, pa.decimal128(18, 2)), number(18, 2)),
        "wide": (pa.array(wide, pa.decimal128(38, 0)), number(38, 0)),
        "fixed": (pa.array(wide, pa.decimal128(38, 0)), {"type": "fixed", "name": "F", "size": 16, "logicalType": "decimal", "precision": 38}),
        "list": (pa.array([[x, None] for x in longs]), {"type": "array", "items": ["null", "long"]}),
    }


@pytest.mark.parametrize("how", ["plain", "first", "last"])
def test_avro_columns(how, monkeypatch):
    """Encoding by column gives the bytes of encoding by value, for any slice; decoding by column gives the columns back."""
    import pyarrow as pa

    columns = _columns(7)
    union = {"plain": lambda t: t, "first": lambda t: ["null", t], "last": lambda t: [t, "null"]}[how]
    arrays = {k: a if how == "plain" else pa.array([None if i % 3 == 1 or i > 40 else x for i, x in enumerate(a.to_pylist())], a.type) for k, (a, _) in columns.items()}
    schema = avro.linked({"type": "record", "name": "R", "fields": [{"name": k, "type": union(t)} for k, (_, t) in columns.items()]})
    batch = pa.RecordBatch.from_pydict(arrays)
    decode = avro.decoding(schema, schema, batch.schema)
    for at, n in ((0, 70), (1, 5), (13, 40), (41, 29), (3, 0)):
        part = batch.slice(at, n)
        want = bytearray()
        for row in part.to_pylist():
            avro.encode(schema, row, want)
        raw = avro.encoded(schema, part, False)
        assert raw == bytes(want)
        assert decode(n, raw).to_pylist() == part.to_pylist()
        for name, (_, t) in columns.items():
            kind = avro.linked(union(t))
            alone = avro.encoded(kind, part.select([name]), True)
            assert avro.decoding(kind, kind, part.select([name]).schema)(n, alone).to_pylist() == part.select([name]).to_pylist()
    with pytest.raises((EOFError, IndexError)):
        decode(70, avro.encoded(schema, batch, False)[:-1])

    def by_value(*args):
        raise AssertionError("a value is handled alone")

    usual = batch.select(["l", "i", "s", "r", "d", "day", "at", "millis", "price"])
    fields = avro.linked({"type": "record", "name": "R", "fields": [f for f in schema["fields"] if f["name"] in usual.schema.names]})
    back = avro.decoding(fields, fields, usual.schema)
    monkeypatch.setattr(avro, "encode", by_value)
    monkeypatch.setattr(avro.Decoder, "value", by_value)
    assert back(70, avro.encoded(fields, usual, False)).equals(usual)


def test_avro_decimals_are_checked():
    """Digits beyond the precision are an error, whatever their number; a null in a type without null is one as well."""
    import pyarrow as pa

    number = lambda p: {"type": "bytes", "logicalType": "decimal", "precision": p, "scale": 1}
    for n, p in ((12345, 5), (-12345, 5), (10**20, 21)):
        raw = avro.encoded(number(p), pa.RecordBatch.from_pydict({"v": pa.array([Decimal(n).scaleb(-1)], pa.decimal128(p, 1))}), True)
        for q in (p - 1, p):
            read = avro.decoding(number(p), number(q), pa.schema([("v", pa.decimal128(q, 1))]))
            if q == p:
                assert read(1, raw).to_pylist() == [{"v": Decimal(n).scaleb(-1)}]
            elif len(str(abs(n))) > q:
                with pytest.raises(pa.ArrowInvalid):
                    read(1, raw)
    with pytest.raises(TypeError):
        avro.encoded("long", pa.RecordBatch.from_pydict({"v": pa.array([1, None])}), True)


@pytest.mark.parametrize("kind, written, arrow", [("long", 2**64, "int64"), ("long", 2**80, "int64"), ("int", 2**31, "int32"), ("millis", 2**60, "int64"), ("millis", -(2**62), "int64")])
def test_avro_numbers_are_checked(kind, written, arrow):
    """A number that its column cannot hold is an error."""
    import pyarrow as pa

    schema = {"type": "long", "logicalType": "timestamp-millis"} if kind == "millis" else kind
    n, raw = (written << 1) ^ -(written < 0), bytearray()
    while n > 0x7F:
        raw.append(n & 0x7F | 0x80)
        n >>= 7
    raw.append(n)
    with pytest.raises((OverflowError, pa.ArrowInvalid)):
        avro.decoding(schema, schema, pa.schema([("v", arrow)]))(2, bytes(raw) + b"\2")
    assert avro.decoding(schema, schema, pa.schema([("v", arrow)]))(2, b"\1\2").to_pydict() == {"v": [-1000, 1000] if kind == "millis" else [-1, 1]}


def test_avro_overwrite_replaces(spark, at):
    p = Pipeline(spark)
    sinks.avro(p.from_rows([1, 2], kinds.longs()), at("numbers"))
    sinks.avro(p.from_rows([3], kinds.longs()), at("numbers"), mode="overwrite")
    assert p.read_avro_file(at("numbers")).collect() == [3]


@pytest.mark.parametrize("text", ["a\nb", "a\rb"])
def test_text_that_would_not_come_back_fails(spark, at, text):
    p = Pipeline(spark)
    with pytest.raises(Exception, match="line break"):
        sinks.text(p.from_rows([text], kinds.strings()), at("lines"))
    with pytest.raises(Exception, match="a key has"):
        sinks.text(p.from_pairs([("a\tb", "c")], kinds.table_of(kinds.strings(), kinds.strings())), at("pairs"))


def test_lines_of_resources():
    assert readers.lines_of("a\nb\r\nc\rd\u2028e\x0bf\x85g\x0c\n\nh") == ["a", "b", "c", "d\u2028e\x0bf\x85g\x0c", "", "h"]
    assert readers.lines_of("a\n") == ["a"] and readers.lines_of("") == [] and readers.lines_of("\n") == [""]


class Two(Workflow):
    broken = False

    def build(self):
        words = self.input("words", self.pipeline.from_rows(["a", "b", "a"], kinds.strings()))
        counted = words.count()
        self.output("twice", counted.map_pairs(lambda k, v: (k, v * 2)))
        self.output("keys", counted.keys().map(lambda k: F.raise_error(F.lit("no")).cast("string") if self.broken else k))


def test_workflow_publishes_all_or_nothing(spark, at, tmp_path):
    flow = Two(spark)
    where = flow.run(at("out"))
    assert dict(map(tuple, spark.read.parquet(where["twice"]).collect())) == {"a": 4, "b": 2}
    assert [b.opaque for b in shared_parents(list(flow.outputs.values()))] == [True]
    with pytest.raises(FileExistsError):
        Two(spark).run(at("out"))
    bad = Two(spark)
    bad.broken = True
    with pytest.raises(Exception):
        bad.run(at("bad"))
    assert not (tmp_path / "bad").exists() and not list(tmp_path.glob("*staging*"))


def test_failed_publishing_takes_back(tmp_path):
    """Where the second of two renames fails, the first is undone."""
    import shutil

    class Disk:
        def exists(self, p):
            return p.exists()

        def rename(self, a, b):
            if b.name == "two" and b.parent.name == "out":
                return False
            shutil.move(a, b)
            return True

    for n in ("one", "two"):
        (tmp_path / "stage" / n).mkdir(parents=True)
    (tmp_path / "out").mkdir()
    import pathlib

    with pytest.raises(OSError):
        publish(Disk(), pathlib.Path, f"{tmp_path}/stage", f"{tmp_path}/out", ["one", "two"])
    assert sorted(x.name for x in (tmp_path / "stage").iterdir()) == ["one", "two"] and not list((tmp_path / "out").iterdir())
    publish(Disk(), pathlib.Path, f"{tmp_path}/stage", f"{tmp_path}/new", ["one", "two"])
    assert sorted(x.name for x in (tmp_path / "new").iterdir()) == ["one", "two"]


def test_workflow_adds_to_a_folder(spark, at, tmp_path):
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "other").mkdir()
    where = Two(spark).run(at("out"))
    assert spark.read.parquet(where["twice"]).count() == 2 and not list(tmp_path.glob("*staging*"))


def test_workflow_needs_inputs_and_outputs(spark):
    class Nothing(Workflow):
        def build(self):
            pass

    with pytest.raises(ValueError):
        Nothing(spark).built()


def test_streams(spark, at):
    p = Pipeline(spark)
    sinks.text(p.from_rows(["a b", "b"], kinds.strings()), at("in"))
    words = streams.text_stream(spark, at("in")).flat_map(lambda v: F.split(v, " "))
    streams.to_memory(streams.running(words.key_by(lambda v: v), "count"), "counted", "complete")
    assert dict(map(tuple, spark.table("counted").collect())) == {"a": 1, "b": 2}
    events = spark.createDataFrame([(0, "x", 1), (61, "x", 2), (3000, "y", 5)], "s int, k string, v int").select(F.timestamp_seconds("s").alias("ts"), "k", "v")
    events.write.parquet(at("events"))
    stream = streams.parquet_stream(spark, at("events"), events.schema)
    out = streams.windowed(stream, "ts", F.col("k"), F.col("v"), "total", "1 minute", "1 minute")
    streams.to_memory(out, "windows", "append")
    got = {(r.key.start.minute, r.key.key): r.value for r in spark.table("windows").collect()}
    assert got == {(0, "x"): 1, (1, "x"): 2}
