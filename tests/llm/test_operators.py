"""Operators on small tables against brute-force versions, and on odd tables."""

import math
import random
import re
import zlib
from collections import Counter
from hashlib import sha256

import pytest

from millrace.llm import bpe, decontam, html_extract, license_scan, lm, neardup, pii, quality, toxicity, warc
from millrace.llm.common import saved
from millrace.llm.queries import tokenizer_path

PATH = tokenizer_path()
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs(spark, *rows):
    """Documents with columns besides whose names operators use themselves."""
    df = spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], DOCS)
    return df.selectExpr("*", "'x' as th", "1 as row", "array(1) as words", "'y' as spans", "2 as n", "'z' as _h", "0 as ids", "'q' as `group`")


def wide(spark, *rows):
    return docs(spark, *rows).repartition(3)


LONG = " ".join(f"w{k}" for k in range(30_000))
ODD = [(1, None), (2, ""), (3, " \n"), (None, "a b c"), (None, None), (4, "a b c"), (4, "a b c"), (5, "word"), (6, LONG), (7, LONG)]


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def solid(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(LOW)) if w]


# ------------------------------------------------------------------ decontamination


def brute_hits(text, items):
    words = alnum(text)
    hit, ids = set(), set()
    for item_id, t in items:
        w = alnum(t)
        if not w:
            continue
        span = min(13, len(w))
        windows = {tuple(w[i : i + span]) for i in range(len(w) - span + 1)}
        for i in range(len(words) - span + 1):
            if tuple(words[i : i + span]) in windows:
                hit |= set(range(i, i + span))
                if item_id is not None:
                    ids.add(str(item_id))
    return len(words), len(hit), len(ids), sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words)


def check_hits(spark, rows, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontam.judged(wide(spark, *rows), bench).collect())
    assert got == Counter((i, *brute_hits(t, items)) for i, t in rows)


def test_decontamination(spark):
    rng = random.Random(1)
    word = lambda: rng.choice("abcde")
    item = lambda n: " ".join(f"{word()}{rng.randint(0, 30)}" for _ in range(n))
    items = [(k, item(rng.randint(13, 40))) for k in range(12)] + [(None, item(20)), (3, item(15)), (50, None), (51, ""), (52, " ".join("ab" * 20))]
    rows = list(ODD)
    for k in range(60):
        w = item(rng.randint(5, 80)).split()
        source = rng.choice(items)[1] or "x"
        part = source.split()
        cut = part[rng.randint(0, max(0, len(part) - 14)) :][: rng.randint(8, 40)]
        at = rng.randint(0, len(w))
        rows.append((100 + k, " ".join(w[:at]) + " " + ", ".join(cut).upper() + " " + " ".join(w[at:])))
    rows += [(200, " ".join("ab" * 60)), (201, " ".join([items[0][1]] * 50))]
    check_hits(spark, rows, items)


def test_decontamination_with_short_items(spark):
    rng = random.Random(2)
    text = lambda n: " ".join(rng.choices("abc", k=n))
    items = [(1, "a b c a"), (2, "b"), (3, text(12)), (4, text(13)), (5, text(30)), (6, "é É")]
    check_hits(spark, [*ODD[:8], *[(k, text(rng.randint(0, 60))) for k in range(10, 40)], (90, "é É é")], items)


def test_decontamination_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 1)
    items = [(k, " ".join(f"i{k}x{j}" for j in range(20))) for k in range(5)]
    check_hits(spark, [(1, items[0][1]), (2, "x " + items[3][1] + " y"), (3, "x")], items)


def test_repetitive_texts_make_few_rows(spark):
    """Rows grow with the length of a text, never with its product with an item."""
    text, item = "same " * 20_000, "same " * 1000
    df = decontam._docs(docs(spark, (1, text)))
    assert decontam.fingerprints(df, [13]).count() <= 20_000 / decontam.RUN + 2
    items = decontam.prepared(spark.createDataFrame([(7, item)], "item_id long, text string"))
    heads, runs = decontam.touched(df, decontam.marks(items, 13, "m").selectExpr("span", "explode(m) as mark").distinct(), [13], True)
    assert heads.count() == 1 and decontam.windows(runs).count() <= 20_000 + decontam.RUN
    check_hits(spark, [(1, text), (2, "other " + text)], [(7, item), (8, "same " * 14)])


def test_winnowing_keeps_few_rows_and_misses_no_span(spark):
    rng = random.Random(9)
    text = " ".join(f"w{rng.randint(0, 3000)}" for _ in range(8000))
    df = decontam._docs(docs(spark, (1, text)))
    assert decontam.fingerprints(df, [13]).count() < 0.35 * 8000
    words = text.split()
    check_hits(spark, [(1, text)], [(k, " ".join(["q", *words[k * 19 : k * 19 + 13], "q"])) for k in range(300)])


def test_decontamination_of_nothing(spark):
    check_hits(spark, ODD[:4], [])
    check_hits(spark, [], [(1, "a b c")])
    check_hits(spark, ODD[:4], [(1, None)])


def test_decontamination_is_native(spark):
    from millrace.plans.inspect import plan_text

    bench = spark.createDataFrame([(1, "a " * 20)], "item_id long, text string")
    plan = plan_text(decontam.judged(docs(spark, (1, "x")), bench))
    assert not re.search("Python|Pandas|Arrow", plan)


# ------------------------------------------------------------------ near-duplicates


def brute_groups(rows, size, percent):
    sets = []
    for _, t in rows:
        w = solid(t)
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[x][0] for x in range(len(rows)) if find(x) == find(k)]
        least = min((x for x in ids if x is not None), default=None) if sets[k] else i
        out.append((i, len(sets[k]), least, i == least))
    return out


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.random()}"
    return " ".join(words)


def near_rows():
    rng = random.Random(3)
    rows = list(ODD)
    for base in range(6):
        words = [f"b{base}w{rng.randint(0, 500)}" for _ in range(rng.choice([8, 40, 150, 400]))]
        rows += [(1000 * (base + 1) + k, edited(rng, words, rng.randint(0, 1 + len(words) // 30))) for k in range(25)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("rule", [neardup.Rule(3, 85), neardup.Rule(), neardup.Rule(3, 85, neardup.EXACT)])
def test_near_duplicates(spark, rule):
    rows = near_rows()
    got = Counter(tuple(r) for r in neardup.judged(wide(spark, *rows), rule).collect())
    assert got == Counter(brute_groups(rows, rule.size, rule.percent))


@pytest.mark.parametrize("limit", [1, 1_000_000])
def test_near_duplicates_in_small_blocks(spark, monkeypatch, limit):
    monkeypatch.setattr(neardup, "BLOCK", 4)
    monkeypatch.setattr(neardup, "HUB", 3)
    monkeypatch.setattr(neardup, "FEW_ROWS", 0)
    monkeypatch.setattr(neardup, "BROADCAST_ROWS", limit)
    monkeypatch.setattr(neardup, "BROADCAST_VALUES", limit)
    rows = near_rows()
    rule = neardup.Rule(3, 85)
    assert Counter(tuple(r) for r in neardup.judged(wide(spark, *rows), rule).collect()) == Counter(brute_groups(rows, 3, 85))


def test_rows_grow_with_the_size_of_a_group(spark, monkeypatch):
    """Near copies of one text meet their pivot once each, not one another."""
    monkeypatch.setattr(neardup, "BLOCK", 16)
    monkeypatch.setattr(neardup, "HUB", 20)
    monkeypatch.setattr(neardup, "FEW_ROWS", 100)
    counted = []
    plain = neardup.candidates
    monkeypatch.setattr(neardup, "candidates", lambda grouped, *a, **b: counted.append(grouped.count()) or plain(grouped, *a, **b))
    rng = random.Random(4)
    words = [f"g{k}" for k in range(120)]
    far = [f"{w}z" if k % 3 == 0 else w for k, w in enumerate(words)]
    for n in (200, 400):
        rows = [(k, edited(rng, words, 1)) for k in range(n)] + [(10_000 + k, edited(rng, far, 1)) for k in range(10)]
        got = Counter(tuple(r) for r in neardup.judged(wide(spark, *rows), neardup.Rule(3, 85)).collect())
        assert got == Counter(brute_groups(rows, 3, 85))
    assert counted[1] <= 2.5 * counted[0] + 100 and max(counted) < 30 * 400


def test_failed_edges_lose_no_link(spark, monkeypatch):
    """With useless bounds the forest is mostly wrong: the second pass has to find all links."""
    monkeypatch.setattr(neardup, "BITS", 64)
    rows = [r for r in near_rows() if r[1] and len(r[1]) < 5000]
    rule = neardup.Rule(3, 85)
    assert Counter(tuple(r) for r in neardup.judged(docs(spark, *rows), rule).collect()) == Counter(brute_groups(rows, 3, 85))


def test_no_documents(spark):
    assert neardup.judged(docs(spark)).collect() == []
    assert neardup.deduplicated(docs(spark)).collect() == []
    assert [tuple(r) for r in neardup.judged(docs(spark, (1, ""))).collect()] == [(1, 0, 1, True)]


def test_components(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 90), (101, 100), (7, 7)]
    got = dict(map(tuple, neardup.components(spark.createDataFrame(chain, "a long, b long")).collect()))
    assert got == {**dict.fromkeys(range(41), 0), 90: 90, 100: 90, 101: 90}


def test_deduplicated_keeps_one_of_each_group(spark):
    text = " ".join(f"t{k}" for k in range(60))
    df = docs(spark, (3, text), (2, text), (2, text), (9, text + " more"), (5, "alone in the world today"), (None, ""), (None, ""), (None, text), (8, None))
    out = neardup.deduplicated(df)
    assert out.columns == df.columns
    assert Counter((r.doc_id, r.text and r.text[:5]) for r in out.collect()) == Counter([(2, "t0 t1"), (5, "alone"), (None, ""), (None, ""), (8, None)])
    assert {r._h for r in out.collect()} == {"z"}


# ------------------------------------------------------------------ language model


def test_base_scores(spark):
    rows = [*ODD[:8], *[(k, " ".join(random.Random(k).choices(["the", "A", "of", f"w{k}", "é", "w1"], k=k))) for k in range(10, 60)]]
    got = sorted(map(repr, ((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in lm.scored(wide(spark, *rows)).collect())))
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 7 == 2
    counts = Counter(w for i, t in rows if not held(i) for w in [*solid(t), None])
    total, kinds = sum(counts.values()), len(counts)
    want = []
    for i, t in rows:
        tokens = [*solid(t), None]
        base = sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in tokens)
        want.append((i, held(i), len(tokens), sum(w in counts for w in tokens), total, round(base, 6)))
    assert got == sorted(map(repr, want))


def test_scores_beat_the_base_on_unseen_texts(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = lm.scored(rows).groupBy("held_out").agg({"score": "sum", "base_score": "sum"}).collect()
    assert all(r["sum(score)"] > r["sum(base_score)"] for r in got) and len(got) == 2


class BruteModel:
    """The definition, word by word, from counts of all trigrams of the training texts."""

    def __init__(self, texts):
        self.one, self.two, self.three, self.after = Counter(), Counter(), Counter(), Counter()
        for t in texts:
            w = [*solid(t), None]
            self.one.update(w)
            self.after.update(["<s>", *w[:-1]])
            self.two.update(zip(["<s>", *w], w))
            self.three.update(zip(["<s>", *w], w, w[1:]))
        self.total, self.kinds = sum(self.one.values()), len(self.one)

    def p1(self, w):
        return (self.one[w] + 1) / (self.total + self.kinds + 1)

    def p2(self, v, w):
        return (self.two[v, w] + lm.K2 * self.p1(w)) / (self.after[v] + lm.K2)

    def p3(self, u, v, w):
        return (self.three[u, v, w] + lm.K3 * self.p2(v, w)) / (self.two[u, v] + lm.K3)

    def score(self, t):
        w = ["<s>", *solid(t), None]
        return math.log10(self.p2(*w[:2])) + sum(math.log10(self.p3(*w[k : k + 3])) for k in range(len(w) - 2))


def brute_scores(rows):
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 7 == 2
    model = BruteModel([t for i, t in rows if not held(i)])
    return [(i, model.score(t)) for i, t in rows]


@pytest.mark.parametrize("chunk, size", [(lm.CHUNK, lm.BUCKET), (200, 50), (1, 7)])
def test_scores_use_all_trigrams(spark, monkeypatch, chunk, size):
    """How texts are dealt out never changes a score."""
    monkeypatch.setattr(lm, "CHUNK", chunk)
    monkeypatch.setattr(lm, "BUCKET", size)
    rng = random.Random(5)
    rows = [(k, " ".join(rng.choice("abcdefgh") * rng.choice((1, 1, 2, 3)) for _ in range(rng.randint(0, 40))) + f" u{k % 50} v{k % 50}") for k in range(120)]
    rows += [(None, None), (3, "a b"), (3, "a b"), (7, "a"), (8, LONG), (9, LONG + " x"), (16, " ".join(["a b c"] * 500))]
    key = lambda r: (r[0] is None, r)
    got = sorted(((r.doc_id, r.score) for r in lm.scored(wide(spark, *rows)).collect()), key=key)
    want = sorted(brute_scores(rows), key=key)
    assert [i for i, _ in got] == [i for i, _ in want]
    assert [s for _, s in got] == pytest.approx([s for _, s in want], rel=1e-9)


def test_distributions_sum_to_one():
    model = BruteModel(["a a b c", "b a c", "c", "a b d d", ""])
    words = [*model.one, "unseen"]
    assert sum(map(model.p1, words)) == pytest.approx(1)
    for v in ("<s>", "a", "d", "unseen"):
        assert sum(model.p2(v, w) for w in words) == pytest.approx(1)
        assert sum(model.p3("a", v, w) for w in words) == pytest.approx(1)


def walked(model, words):
    """The automaton of ``model`` (counts of a BruteModel) by its definition: one state, arcs, failure arcs, token by token."""
    after, fail = {}, {}
    for u, v, w in model.three:
        after[(u, v), w] = math.log10(model.p3(u, v, w))
    for v, w in model.two:
        after[(v,), w] = math.log10(model.p2(v, w))
        fail[v, w] = (w,), math.log10(lm.K3 / (model.two[v, w] + lm.K3))
    for v, n in [*model.one.items(), ("<s>", model.after["<s>"])]:
        fail[(v,)] = (), math.log10(lm.K2 / ((n if v != "<s>" else model.after[v]) + lm.K2))
    state, total = ("<s>",) if model.after["<s>"] else (), 0.0
    for w in [*words, None]:
        while state and (state, w) not in after:
            state, weight = fail[state][0], fail[state][1]
            total += weight
        total += after[state, w] if state else math.log10(model.p1(w))
        history = (*state, w)[-2:]
        while history and not (history in fail):
            history = history[1:]
        state = history
    return total


def test_arcs_and_failure_arcs(spark):
    """The traversal of all tokens at once is that of one state carried along arcs and failure arcs."""
    rng = random.Random(12)
    texts = [" ".join(rng.choices("abcde", k=rng.randint(0, 30))) for _ in range(60)]
    held = [k % 3 == 0 for k in range(60)]
    rows = spark.createDataFrame([(k, t + (" new" if h else ""), h) for k, (t, h) in enumerate(zip(texts, held))], "doc_id long, text string, h boolean")
    c = lm._read(lm.chunks(rows.coalesce(1), "doc_id", "text", rows["h"]).toArrow())
    brute = BruteModel([t for t, h in zip(texts, held) if not h])
    model = lm.Automaton(c, c.own(1), c.own(2), c.own(3), brute.total, brute.kinds)
    assert int(model.is_triple.sum()) == len(brute.three) and int(model.is_pair.sum()) == len(brute.two)
    want = {k: walked(brute, solid(t + (" new" if h else ""))) for k, (t, h) in enumerate(zip(texts, held))}
    assert dict(zip(c.ids, model.scores().tolist())) == pytest.approx(want)
    assert want == pytest.approx({k: brute.score(t + (" new" if h else "")) for k, (t, h) in enumerate(zip(texts, held))})


def test_language_model_of_nothing(spark):
    assert lm.scored(docs(spark)).collect() == []
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = lm.scored(docs(spark, (held, "a b"))).first()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (True, 3, 0, 0, 0.0) and math.isfinite(r.score)


# ------------------------------------------------------------------ toxicity


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    bad = "clown|idiot|disgusting|loser|scum|pathetic|stupid|trash|moron|worthless"
    out = toxicity.judged(documents, labels).where("held_out").join(labels, "doc_id").join(documents.select("doc_id", "text"), "doc_id").collect()
    plain = [r for r in out if r.toxic and re.search(rf"\b({bad})\b", r.text.lower())]
    clean = [r for r in out if not r.toxic]
    assert sum(r.predicted for r in plain) >= 0.9 * len(plain)
    assert sum(r.predicted for r in clean) <= 0.02 * len(clean)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)


def test_toxicity_of_odd_tables(spark):
    labels = spark.createDataFrame([(1, None, 1), (None, 1, 1), (6, 1, None), (4, 0, 0), (4, 0, 1), (4, 0, 1)], "doc_id long, quality int, toxic int")
    out = toxicity.judged(wide(spark, *ODD), labels).collect()
    assert len(out) == len(ODD) and all(0 <= r.score <= 1 for r in out)
    none = toxicity.judged(docs(spark, *ODD), labels.limit(0)).collect()
    assert len(none) == len(ODD) and all(r.score == 0 and r.predicted == 0 for r in none)
    assert toxicity.judged(docs(spark), labels).collect() == []


def test_toxicity_sample_is_bounded_in_rows(spark, monkeypatch):
    """A labelled id on many rows neither fills the driver nor drives out the other ids."""
    from pyspark.sql.classic.dataframe import DataFrame

    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5 != 0][:4]
    labels = spark.createDataFrame([(i, int(i != ids[0])) for i in ids], "doc_id long, toxic int")
    rows = [(ids[0], f"a b c{k}") for k in range(200)] * 2 + [(i, f"x y z{i}") for i in ids[1:]]
    fetched, learnt = [], []
    fetch = DataFrame.toArrow
    monkeypatch.setattr(DataFrame, "toArrow", lambda self: fetched.append(fetch(self)) or fetched[-1])
    monkeypatch.setattr(toxicity, "ftrl", lambda x, y: learnt.extend(y))
    toxicity.fit(wide(spark, *rows), labels, max_rows=4)
    assert [t.num_rows for t in fetched] == [8]
    assert sorted(learnt) == [0] * 5 + [1] * 3


# ------------------------------------------------------------------ quality


def test_quality_sample_covers_all_partitions(spark, monkeypatch):
    """The order of the rules depends on the table, not on how its rows are dealt out or repeated."""
    rows = [(k, " ".join(f"w{k}x{j}" for j in range(20 + k % 90))) for k in range(300)] + [(1000 + k, "AA BB " * 60) for k in range(300)]
    a = [p for p in quality.sampled(docs(spark, *rows).repartition(5), rows=100)]
    b = [p for p in quality.sampled(docs(spark, *rows, *rows[300:]).repartition(2), rows=100)]
    assert a == b and len(a) == 100
    assert len(quality.sampled(docs(spark, *rows))) == 301
    assert quality.sampled(docs(spark)) == []
    plain = {r.doc_id: (r.kept, r.rejected_by) for r in quality.judge(docs(spark, *rows), figures=False).collect()}
    full = {r.doc_id: (r.kept, r.rejected_by) for r in quality.judge(wide(spark, *rows)).collect()}
    assert plain == full
    assert quality.judge(docs(spark, *rows), figures=False).agg({"work": "sum"}).first()[0] > 0


# ------------------------------------------------------------------ the others on odd tables


def test_one_row_for_each_document(spark):
    empty = docs(spark)
    for f in (lambda d: pii.digest(pii.detect(d.select("doc_id", "text"))), quality.judge, license_scan.find_licenses, lambda d: bpe.round_trip(d, PATH)):
        assert f(empty).collect() == []
        out = f(wide(spark, *ODD)).collect()
        assert Counter(r.doc_id for r in out) == Counter(i for i, _ in ODD)
        same = [tuple(r) for r in out if r.doc_id == 4]
        assert same[0] == same[1]
    spans = {r.doc_id: r for r in pii.digest(pii.detect(docs(spark, (1, None), (2, "x a@b.cd 1.2.3.4")).select("doc_id", "text"))).collect()}
    assert spans[1].base_sha256 == sha256(b"").hexdigest() and spans[1].spans == ""
    assert (spans[2].n_email, spans[2].n_ip, spans[2].spans) == (1, 1, "email:2:8,ip:9:16")
    assert spans[2].base_sha256 == sha256(b"email:2:8,ip:9:16").hexdigest()


def test_columns_are_kept(spark):
    df = docs(spark, (1, "mail a@b.cd"))
    assert pii.detect(df, output="found").columns == [*df.columns, "found"]
    assert pii.redact(df).columns == df.columns and pii.redact(df).first().text == "mail <EMAIL>"
    out = bpe.decode(bpe.encode(df, PATH, output="tokens"), PATH, ids="tokens", output="back")
    assert out.columns == [*df.columns, "tokens", "back"] and out.first().back == "mail a@b.cd"
    r = bpe.tokenise(docs(spark, (1, None), (2, "a b")), PATH).orderBy("doc_id").collect()
    assert (r[0].n_tokens, r[0].ids, r[0].decoded) == (0, [], "")
    assert r[1].n_tokens == len(r[1].ids) == 2 and r[1].decoded == "a b" and r[1].words == [1]


PAGES = "page_id long, url string, html string"


def test_warc(spark):
    big = "x" * 100
    rows = [(5, "u", big), (3, "http://a b\r\n", big), (None, None, big), (9, "u", "y" * 99), (8, "u", "y" * 99), (1, "u", None), (2, "u", ""), (7, "u", "é" * 200_000), (3, "v", big), (4, None, "z" * 300), (None, "u", "n" * 200), (None, "u", "n" * 200)]
    df = spark.createDataFrame(rows, PAGES).selectExpr("*", "1 as digest", "2 as first").repartition(3)
    got = Counter(tuple(r) for r in warc.archived(df).collect())
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        again = len(raw) >= 100 and sum((x or "") == (h or "") for _, _, x in rows) > 1 and first.get(h) is not None and i != first[h]
        want.append((i, len(raw), sha256(raw).hexdigest(), "revisit" if again else "response", first[h] if again else None))
    assert got == Counter(want)
    assert warc.archived(spark.createDataFrame([], PAGES)).collect() == []


def test_warc_files(spark, tmp_path):
    import gzip
    import json

    rows = [(k, f"http://x/{k}", f"<p>{k}</p>" * k) for k in range(50)]
    pages = warc.with_references(spark.createDataFrame(rows, PAGES)).coalesce(1)
    written = warc.write_archives(pages, f"file://{tmp_path}/w")
    (path, n) = written.first()
    assert n == 50 and written.count() == 1
    files = warc.normalise(written)
    target, index, _ = files.first()
    whole = gzip.open(path.removeprefix("file://")).read()
    assert gzip.open(target.removeprefix("file://")).read() == whole
    raw = open(target.removeprefix("file://"), "rb").read()
    lines = [json.loads(x) for x in open(index.removeprefix("file://"))]
    assert b"".join(gzip.decompress(raw[x["offset"] : x["offset"] + x["length"]]) for x in lines) == whole
    back = warc.read_archives(files).collect()
    assert {(r.page_id, r.url, bytes(r.payload).decode()) for r in back} == set(rows)
    with open(path.removeprefix("file://"), "rb") as f:
        cut = f.read()[:-20]
    (tmp_path / "w" / "cut.warc.gz").write_bytes(cut)
    with pytest.raises(Exception):
        warc.normalise(spark.createDataFrame([(f"file://{tmp_path}/w/cut.warc.gz",)], "path string"))


def test_warc_second_attempts(spark, tmp_path):
    """A task that is run again finds its files and leaves the same ones."""
    rows = [(k, f"http://x/{k % 3}", "<p>same</p>" * 20) for k in range(9)] + [(9, "u", "other")]
    pages = warc.with_references(spark.createDataFrame(rows, PAGES)).coalesce(1)
    first = warc.normalise(warc.write_archives(pages, f"file://{tmp_path}/w")).collect()
    before = {f.name: f.read_bytes() for f in (tmp_path / "w").iterdir()}
    again = warc.normalise(warc.write_archives(pages, f"file://{tmp_path}/w"))
    assert again.collect() == first and {f.name: f.read_bytes() for f in (tmp_path / "w").iterdir()} == before
    whole = b"".join(warc._inflated(open(first[0].path.removeprefix("file://"), "rb"))).decode()
    ids, named = re.findall(r"WARC-Record-ID: (\S+)", whole), re.findall(r"WARC-Refers-To: (\S+)", whole)
    assert len(set(ids)) == 10 and named == [warc.record_id(0, sha256(rows[0][2].encode()).hexdigest())] * 8 and named[0] in ids


def test_each_file_is_a_task(spark):
    paths = spark.createDataFrame([(f"p{k}",) for k in range(13)], "path string").repartition(5)
    assert [len(x) for x in warc._each_file(paths).rdd.glom().collect()] == [1] * 13


def test_long_rows_come_in_small_slices():
    import pyarrow as pa

    from millrace.llm.common import SLICE, pieces

    b = pa.RecordBatch.from_pydict({"t": ["x" * (SLICE // 4)] * 20 + ["y"] * 20})
    sizes = [p.num_rows for p in pieces(b, 1000)]
    assert sum(sizes) == 40 and max(sizes) <= 8
    assert [p.num_rows for p in pieces(pa.RecordBatch.from_pydict({"t": ["y"] * 2500}), 1000)] == [1000, 1000, 500]


def test_html_table(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<article><p>a  b</p><p>c</p></article>"), (3, "u", "<nav>x</nav>"), (3, "u", "<nav>x</nav>")]
    df = spark.createDataFrame(rows, PAGES).selectExpr("*", "1 as text", "2 as n_chars")
    out = html_extract.extracted(df, html_extract.train(150)).collect()
    assert Counter(r.page_id for r in out) == Counter([1, 2, None, 3, 3])
    assert {r.page_id: (r.text, r.n_chars) for r in out}[None] == ("a b\n\nc", 6)
    assert {r.page_id: r.text for r in out}[1] == ""
    assert html_extract.extracted(df.limit(0), html_extract.train(150)).collect() == []


def test_saved_tables_stay_readable(spark):
    df = saved(spark.range(5))
    assert df.count() == 5 and df.inputFiles()


def test_scratch_tables_are_removed(spark):
    """After an operator only its result is left in the shared folder."""
    from pathlib import Path

    from millrace.llm.common import discard, tidied

    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")) / "millrace"
    before = set(folder.iterdir()) if folder.exists() else set()
    bench = spark.createDataFrame([(1, "a b c a b c a b c a b c a b c")], "item_id long, text string")
    pages = spark.createDataFrame([(1, "u", "x" * 200)], PAGES)
    with tidied():
        for f in (lambda: neardup.groups(docs(spark, *near_rows()[:40])), lambda: lm.scored(docs(spark, *ODD)), lambda: decontam.judged(docs(spark, *ODD), bench), lambda: warc.archived(pages)):
            left = set(folder.iterdir()) if folder.exists() else set()
            assert f().count() and len(set(folder.iterdir()) - left) == 1
    assert set(folder.iterdir()) == before
    with pytest.raises(ValueError), tidied():
        saved(spark.range(2))
        raise ValueError
    one = saved(spark.range(2))
    discard(one)
    assert set(folder.iterdir()) == before
