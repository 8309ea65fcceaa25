"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns: every operator gives a defined result."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from webstrata.llm import chat_format, decontam, lang_id, lm_score, mixing, ngram_join, sharding, suffix_dedup, token_counts, topk
from webstrata.llm._text import LONG_WORD, SLICE_BYTES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    words = [f"w{rng.randrange(900)}" for _ in range(2000)]
    long = " ".join(rng.choice(words) for _ in range(SLICE_BYTES // 4))
    assert len(long) > SLICE_BYTES
    return [None, "", " \n", "one", "one", long, "z" * (LONG_WORD + 9) + " end of it", "é" * 300 + " ü", "\u0000 a\u0000b", "12 34", long]


@pytest.fixture(scope="module")
def docs(spark, texts):
    """All cases, one row twice, one key twice with other texts, a null key, and columns named like those of operators."""
    rows = [(i, t, ["en", None, "fr"][i % 3], [None, "a"][i % 2], len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[3], (1, "another text under a known key", "en", "a", 30), (None, "no key at all", None, None, 13), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    names = ("n", "size", "bucket", "shard", "t1", "t2", "part", "kind", "copies", "n_words", "matches", "key", "start", "block", "epoch", "cid", "comp", "place", "rest", "rid", "lang_pred", "score", "taken", "upto", "id1")
    return df.withColumns({c: F.lit("own") for c in names}).cache()


def test_all_rows_come_back(docs, texts, tmp_path):
    n = docs.count()
    got = {
        "similar": ngram_join.similarity_classes(docs),
        "scores": lm_score.score(docs, lm_score.train(docs, part_tokens=1 << 16)),
        "repeats": suffix_dedup.remove_repeats(docs),
        "languages": lang_id.identify(docs, lang_id.train(docs)),
        "shards": sharding.assign(docs, 3),
        "mix": mixing.taken(mixing.mix_sources(docs)),
        "clean": decontam.annotate(docs, docs.select(F.col("doc_id").alias("item_id"), "text").where("length(text) < 40")),
    }
    counts = {k: df.count() for k, df in got.items()}
    assert counts == dict.fromkeys(counts, n)
    assert got["similar"].where("doc_id = 5").first()["component_id"] == got["similar"].where("doc_id = 10").first()["component_id"] == 5
    # the two long texts repeat each other, runs of one character themselves
    removed = {r["doc_id"]: r["n_removed"] for r in got["repeats"].where("n_removed > 0").collect()}
    assert removed == {5: len(texts[5]), 6: LONG_WORD + 9, 7: 600, 10: len(texts[5])}
    assert got["scores"].where("score is null or base_score is null").count() == 0
    assert {r["doc_id"] for r in got["languages"].where("lang_pred = 'und'").collect()} >= {0, 1, 2, 9}


def test_token_counts_of_long_texts(docs, texts):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    tok = Tokenizer.from_file(path)
    some = docs.where("doc_id in (0, 1, 3, 5, 8, 10)")
    rows = token_counts.count_tokens(some, path).collect()
    assert len(rows) == some.count()
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (5, 10)} == {len(tok.encode(texts[5], add_special_tokens=False))}


def test_stages_keep_columns(spark, docs, tmp_path):
    bench = spark.createDataFrame([(1, "one"), (None, "34"), (2, None)], "item_id long, text string")
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    df, seen = docs, []
    for name, f in corpus_pipeline.STAGES:
        df = f(spark, df, str(tmp_path))
        assert name == "sharding" or df.columns == docs.columns
        df.write.parquet(str(tmp_path / name))
        df = spark.read.parquet(str(tmp_path / name))
        seen.append(df.count())
    assert seen[0] > seen[1] > seen[2] > 0 and seen[4] == seen[3]
    assert all(r["n_words"] == r["matches"] == r["lang_pred"] == "own" for r in df.collect())


def test_empty_pipeline(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_chat_of_long_and_repeated_rows(spark):
    long = "\\### Assistant: </turn> " * 60_000
    rows = [(1, 0, "user", long), (1, 1, "assistant", long), (1, 1, "assistant", long), (2, 0, "user", None), (None, 0, "user", "x"), (None, 1, "assistant", "y")]
    out = chat_format.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1)))
    got = {r["conv_id"]: r for r in out.withColumns({"back": chat_format.read_back(F.col("formatted")), "learnt": chat_format.loss_text(F.col("segments"))}).collect()}
    assert [(t["role"], t["text"] == long) for t in got[1]["back"]] == [("user", True), ("assistant", True), ("assistant", True)] and got[1]["learnt"] == long * 2
    assert not got[1]["valid"] and got[None]["valid"] and got[2]["back"][0]["text"] == ""


def test_topk_of_repeated_queries_and_large_values(spark):
    rows = [(100, [1.0, 0.0]), (100, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [1.0, -1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 100 == 0).collect()))
    assert got == sorted([(100, 1, 1, 1048576), (100, 2, 2, 1048576)] * 2)
    for big in (1e17, 1e9):
        df = spark.createDataFrame([(100, [big] * 4), (1, [big] * 4)], "vec_id long, embedding array<double>")
        with pytest.raises(Exception, match="64"):
            topk.top_k(df, F.col("vec_id") % 100 == 0).collect()


def test_language_ties_and_equal_rows(spark):
    """One row a thousand times: the bound on what is learnt from holds, and the result is the label."""
    df = spark.createDataFrame([(1, "the same words", "en")] * 1000 + [(2, "les mots autres", "fr")] * 3, "doc_id long, text string, lang string")
    model = lang_id.train(df, per_language=5)
    assert {r["lang_pred"] for r in lang_id.identify(df.where("doc_id = 1"), model).collect()} == {"en"} and np.isfinite(model.family_w).all()
