"""The pipeline on a small corpus whose right result is known."""

import random

import pytest

import corpus_pipeline

BAD = ["clown", "idiot", "disgusting", "scum", "moron"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(8)
    text = lambda n: " ".join(f"w{rng.randint(0, 400)}" for _ in range(n))
    toxic_text = lambda: " ".join([text(20), *rng.sample(BAD, 3), text(20)])
    rows, labels = [], []
    for k in range(600):
        toxic = k % 4 == 0
        rows.append((k, toxic_text() if toxic else text(60)))
        labels.append((k, 1, int(toxic)))
    clean = {i for i, t in rows if i % 4}
    item = text(30)
    words = text(80).split()
    near = " ".join([*words[:40], "changed", *words[41:]])
    rows += [(1000, " ".join(words)), (1001, " ".join(words)), (1002, near)]
    rows += [(1100, text(50) + " " + item.upper()), (1101, text(900) + " " + item)]  # a whole item in a long text
    rows += [(1102, text(900) + " " + " ".join(item.split()[:12]))]
    rows += [(1200, text(60) + " write to a.b@c.de now")]
    rows += [(1300, toxic_text()), (None, None), (None, ""), (1400, "")]
    rows += [(1500, text(60_000)), (1600, text(70)), (1600, text(70)), (1700, (again := text(70))), (1700, again)]  # a very long text, repeated ids and rows
    at = str(tmp_path_factory.mktemp("sf"))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.selectExpr("*", "7 as _toxicity", "'e' as ids").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, item), (2, text(25))], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, rows, clean


def test_run(spark, corpus):
    at, rows, clean = corpus
    texts = {i: t for i, t in rows if i not in (None, 1600)}
    out = corpus_pipeline.run(spark, at).collect()
    by = {r.doc_id: r for r in out}
    ids = sorted(r.doc_id for r in out if r.doc_id is not None)
    assert ids == sorted([*clean, 1000, 1102, 1200, 1400, 1500, 1600, 1600, 1700])
    assert {r.text for r in out if r.doc_id == 1600} == {t for i, t in rows if i == 1600}
    assert sum(r.doc_id is None for r in out) == 2
    for r in out:
        text = texts.get(r.doc_id, r.text)
        if r.doc_id == 1200:
            text = text.replace("a.b@c.de", "<EMAIL>")
        assert r.text == text and r.decoded == (text or "") and r.n_tokens == len(r.ids) and r._toxicity == 7
    assert by[1200].n_chars == len(by[1200].text)


def test_stages_keep_the_columns(spark, corpus):
    at, *_ = corpus
    docs = spark.read.parquet(f"{at}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, at).columns == docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "encoding"]


def test_no_documents(spark, corpus, tmp_path):
    at, *_ = corpus
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{at}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
