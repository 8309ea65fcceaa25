"""The pipeline's stages on a small folder: whole, in order, each rule taking effect."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from webstrata.llm import queries


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(1)
    voc = {"en": ["the", "and", "with", "thing", "over"], "fr": ["est", "que", "très", "eau", "nous"]}
    make = lambda x, n: " ".join(rng.choice(voc[x]) + str(rng.randrange(50)) for _ in range(n))
    rows = [(i, make(x, rng.randrange(20, 90)), x, f"s{i % 3}", 0) for i, x in enumerate(rng.choice(["en", "fr"]) for _ in range(60))]
    bench = make("en", 40)
    rows += [(100, rows[0][1], "en", "s0", 0), (101, "123 456", "en", None, 0), (102, f"so {bench}", "en", "s1", 0), (103, None, None, "s1", 0)]
    out = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("extra", F.lit("x")).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "ngram_join", "decontamination", "mixing", "sharding"]
    seen, cols = {}, docs.columns
    for k, (name, f) in enumerate(corpus_pipeline.STAGES):
        docs = f(spark, docs, folder)
        docs.write.parquet(f"{folder}/out-{k}")
        docs = spark.read.parquet(f"{folder}/out-{k}")
        seen[name] = sorted(r["doc_id"] for r in docs.select("doc_id").collect())
        assert k == 4 or docs.columns == cols
    assert seen["language_id"] == [*range(60), 100, 102]
    assert seen["ngram_join"] == [*range(60), 102] and seen["decontamination"] == list(range(60))
    assert set(seen["mixing"]) <= set(range(60)) and seen["sharding"] == seen["mixing"]


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.count() > 0 and {"shard", "slot", "text"} <= set(out.columns)


def test_near_copies_of_hashes_alike(spark):
    """Hashes of the first and third text, single n-grams, share their upper 40 bits; the first comes twice in the task."""
    texts = ["w3144992", "w3144992 ", "w1291506", "w8", "w8 "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2, 3]


def test_near_copies_pass_in_small_batches(spark, tmp_path):
    """12 MB of text in one task: Python gets it in batches of bounded bytes, and the caller's setting is as before."""
    name, log = "spark.sql.execution.arrow.maxBytesPerBatch", str(tmp_path / "sizes")
    make = lambda i: " ".join(f"w{i}x{k % 3000}" for k in range(4000))
    spark.createDataFrame([(i, make(i)) for i in range(300)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/docs")

    def noted(batches):
        for batch in batches:
            with open(log, "a") as f:
                f.write(f"{batch.nbytes}\n")
            yield batch

    docs = spark.read.parquet(f"{tmp_path}/docs").mapInArrow(noted, "doc_id long, text string")
    before = spark.conf.get(name, None)
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    with open(log) as f:
        assert max(map(int, f)) < 6 << 20
    assert kept.count() == 300 and spark.conf.get(name, None) == before
    spark.conf.set(name, 1 << 20)
    try:
        corpus_pipeline.drop_near_copies(spark, docs.limit(3), "")
        assert spark.conf.get(name) == str(1 << 20)
    finally:
        spark.conf.unset(name)


def test_mixing_starts_no_other_workers(spark, folder, monkeypatch):
    """A table from a list goes through workers of RDDs, which stay beside those of functions."""

    def no(*_):
        raise AssertionError("rows pass through an RDD of Python")

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", no)
    assert corpus_pipeline.mix(spark, docs, folder).count() > 0


def test_names():
    assert [int(q[2:].split("_")[0]) for q in queries.QUERIES] == list(range(1, 11))
    assert set(queries.SQL) <= set(queries.QUERIES)
