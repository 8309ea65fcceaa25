"""Each operator against a plain statement of its rule, with nulls, ties, repeated rows, empty tables and clashing columns."""

import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from brute import SPACED, components, contamination, low, repeats, sha
from pyspark.sql import functions as F

from webstrata.llm import _induced, chat_format, decontam, lang_id, lm_score, mixing, ngram_join, sharding, suffix_dedup, token_counts, topk
from webstrata.llm._text import ALNUM, SPACED as SPACED_BYTES
from webstrata.llm._text import flat, word_hashes, words

DOCS = "doc_id long, text string, source string, lang string, n_chars long"


def made(rng, n, vocab=40):
    return " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    base = made(rng, 120, 400)
    near = [" ".join(w if rng.random() > 0.01 else "changed" for w in base.split()) for _ in range(6)]
    passage = made(rng, 70, 300)
    out = [base, base, *near, None, "", " \t\n", "One", "one", "a b c d", "A  b\tC d", "Ünï cödé — ça", "x" * 5000, "y " * 3000]
    out += [made(rng, rng.randrange(5, 90), 60) for _ in range(12)]
    out += [f"{made(rng, 30, 500)} {passage} {made(rng, 20, 500)}" for _ in range(4)]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, [None, "a", "b", "B"][i % 4], ["en", "de", None][i % 3], len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_words_and_hashes():
    data, offs = flat(pa.array(["Ab c", None, "c-d", "é x"]))
    s, e, by = words(data, offs, SPACED_BYTES)
    assert [bytes(data[a:b]).decode() for a, b in zip(s, e, strict=True)] == ["Ab", "c", "c-d", "é", "x"] and by.tolist() == [0, 2, 2, 3, 5]
    s2, e2, _ = words(data, offs, ALNUM)
    assert [bytes(data[a:b]).decode() for a, b in zip(s2, e2, strict=True)] == ["b", "c", "c", "d", "é", "x"]
    h = word_hashes(data, s2, e2)
    assert h[1] == h[2] and len(set(h.tolist())) == 5


def test_chat_round_trip(spark):
    odd = ["\\### Assistant: </turn> ok", "####", "#\\###", "</turn></turn>", "a\\", "", None, "### ", "</tur", "\n</turn>\n"]
    rows = [(1, i, ["user", "assistant"][i % 2], t, "extra") for i, t in enumerate(odd)]
    rows += [(2, 0, "assistant", "early", ""), (3, 0, None, "x", ""), (3, 1, "to:ol ", "y", ""), (None, 0, "user", "q", ""), (None, 1, "assistant", "a", ""), (4, 0, "user", "z", ""), (4, 0, "user", "b", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    out = chat_format.format_chat(df)
    got = {r["conv_id"]: r for r in out.select("*", chat_format.read_back(F.col("formatted")).alias("back"), chat_format.loss_text(F.col("segments")).alias("loss")).collect()}
    assert [(x["role"], x["text"]) for x in got[1]["back"]] == [(["user", "assistant"][i % 2], t or "") for i, t in enumerate(odd)]
    assert got[1]["loss"] == "".join(t or "" for i, t in enumerate(odd) if i % 2) and got[1]["valid"]
    assert not got[2]["valid"] and got[2]["bad_turn"] == 0
    assert [x["role"] for x in got[3]["back"]] == ["", "to:ol "] and not got[3]["valid"]
    assert got[None]["valid"] and [x["text"] for x in got[4]["back"]] == ["b", "z"]
    assert chat_format.format_chat(df.limit(0)).count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_decontamination(spark, docs, texts):
    rng = random.Random(5)
    long = made(rng, 30, 200)
    bench = [(1, long), (10, "One"), (2, None), (3, ""), (4, " ".join(long.split()[5:25])), (4, "again w"), (5, texts[0])]
    extra = [(100, f"intro {long} end"), (101, " ".join(long.split()[2:16])), (102, " ".join(long.split()[:12]))]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string")).withColumn("matches", F.lit(1))
    b = spark.createDataFrame(bench, "item_id long, text string")
    for block in (8 << 20, 300):
        got = {r["doc_id"]: r for r in decontam.annotate(df, b, block_bytes=block).collect()}
        for i, t in [*enumerate(texts), *extra]:
            n, hit, items = contamination(t, bench)
            assert (got[i]["n_words"], got[i]["n_hit"], set(got[i]["items"])) == (n, hit, items), (i, block)
            assert got[i]["contaminated"] == (hit > 0 and 20 * hit >= n)
    best = max(got[100]["matches"], key=lambda m: m["n_words"])
    assert (best["item_id"], best["item_word"], best["doc_word"], best["n_words"]) == (1, 0, 1, 30)
    assert decontam.decontaminate(docs, b.limit(0)).count() == len(texts) and decontam.annotate(docs.limit(0), b).count() == 0


def test_decontamination_without_id(spark):
    long = made(random.Random(6), 30, 200)
    df = spark.createDataFrame([(1, f"a {long} b"), (2, "other words")], "doc_id long, text string")
    other = made(random.Random(7), 90, 200)
    b = spark.createDataFrame([(None, long), (3, other), (None, None)], "item_id long, text string")
    for block in (8 << 20, 300):
        got = {r["doc_id"]: r for r in decontam.annotate(df, b, block_bytes=block).collect()}
        assert (got[1]["n_hit"], got[1]["contaminated"], got[1]["items"]) == (30, True, []) and {m["item_id"] for m in got[1]["matches"]} == {None}
        assert not got[2]["contaminated"]


def test_decontaminate_keeps_own_columns(spark):
    long = made(random.Random(6), 30, 200)
    df = spark.createDataFrame([(1, f"a {long} b", 7, "m"), (2, "other words", 8, None)], "doc_id long, text string, n_words int, MATCHES string")
    got = decontam.decontaminate(df, spark.createDataFrame([(3, long)], "item_id long, text string"))
    assert got.columns == df.columns and [tuple(r) for r in got.collect()] == [(2, "other words", 8, None)]


def test_decontamination_of_one_repeated_word(spark):
    bench, text = "na " * 400, "x " + "na " * 6000 + "y"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = decontam.annotate(df, spark.createDataFrame([(3, bench)], "item_id long, text string")).first()
    assert (got["n_words"], got["n_hit"], got["items"]) == (6002, 6000, [3])


def test_mixing_with_clashing_names(docs):
    odd = docs.select("doc_id", "source", "text").withColumns({"mix_id1": F.lit(1), "mix_runs": F.lit(None).cast("string"), "__key": F.lit(2), "key": F.lit(3), "size": F.lit(4)})
    got, want = mixing.mixed(odd, block_words=16), mixing.mixed(docs, block_words=16)
    assert got.columns == odd.columns and sorted(map(str, got.select("doc_id", "text").collect())) == sorted(map(str, want.select("doc_id", "text").collect()))


def test_targets_reshare():
    assert mixing.targets([10, 10, 10]) == pytest.approx([20.0, 8.333333, 16.666667])
    assert mixing.targets([]) == [] and mixing.targets([0, 5]) == pytest.approx([0, 7.5])


def test_permutation():
    n = np.full(1000, 1000)
    key = np.full(1000, 77, np.uint64)
    p = mixing.permute(np.arange(1000), n, key)
    assert sorted(p.tolist()) == list(range(1000)) and mixing.permute(p, n, key, back=True).tolist() == list(range(1000))


def test_mixing(spark, docs, texts, empty):
    df = docs.unionByName(docs.where("doc_id < 3")).withColumn("taken", F.lit("clash"))
    m = mixing.mix_sources(df, block_words=16, n_shards=5)
    rows = mixing.taken(m).collect()
    size = {i: len(SPACED.findall(t or "")) for i, t in enumerate(texts)}
    assert len(rows) == len(texts) + 3 and all(r["size"] == size[r["key"]] and r["taken"] <= 2 * r["size"] for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    for rs in by.values():
        assert sum(r["size"] for r in rs) == rs[0]["source_size"] and sum(r["taken"] for r in rs) == math.floor(rs[0]["target"] + 1e-6)
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.taken(mixing.mix_sources(df, block_words=16, n_shards=5)).collect()), key=str)
    text = mixing.mixed(df, block_words=16, n_shards=5).collect()
    assert sum(len(SPACED.findall(r["text"])) for r in text) == sum(r["taken"] for r in rows) and all(r["n_chars"] == len(r["text"]) for r in text)
    counts = [r["n"] for r in m.slots.groupBy("out_shard").agg(F.count("*").alias("n")).collect()]
    assert max(counts) - min(counts) <= 1
    assert mixing.taken(mixing.mix_sources(empty)).count() == 0 and mixing.mixed(empty).count() == 0


def test_similarity_classes(docs, texts, empty):
    rows = ngram_join.similarity_classes(docs.withColumn("cid", F.lit(0))).collect()
    want = components([(i, t) for i, t in enumerate(texts) if t and t.split()])
    named = dict(zip([i for i, t in enumerate(texts) if t and t.split()], want, strict=True))
    assert len(rows) == len(texts) and all(r["component_id"] == named.get(r["doc_id"], r["doc_id"]) for r in rows)
    kept = ngram_join.one_of_each(docs.unionByName(docs.where("doc_id = 0")))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({named.get(i, i) for i in range(len(texts))}) and kept.columns == docs.columns
    assert ngram_join.similarity_classes(empty).count() == 0


def test_signatures():
    rng = np.random.default_rng(4)
    for a, b, shared in ((700, 650, 500), (40, 90, 30), (3000, 100, 100), (0, 5, 0)):
        pool = rng.integers(0, 1 << 63, a + b).astype(np.uint64)
        x, y = np.unique(pool[:a]), np.unique(pool[a - shared : a - shared + b])
        sx, sy = ngram_join.signatures(np.concatenate([x, y]), np.array([len(x), len(y)])).to_pylist()
        assert ngram_join.differing(sx, sy) == ngram_join.differing(sy, sx) <= len(np.setxor1d(x, y))


def test_one_of_each_with_clashing_names(docs, texts):
    odd = docs.select("doc_id", "text").withColumns({"keep_key": F.lit(1), "keep_hash": F.lit("x"), "__key": F.lit(2), "component_id": F.lit(3), "cid": F.lit(4)})
    kept = ngram_join.one_of_each(odd.unionByName(odd.where("doc_id in (0, 3)")))
    assert kept.columns == odd.columns and kept.count() == ngram_join.one_of_each(docs).count()


def test_similarity_random(spark):
    rng = random.Random(11)
    groups = [made(rng, rng.randrange(20, 60), 2000) for _ in range(8)]
    rows = []
    for i in range(120):
        w = rng.choice(groups).split()
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(9)}"
        rows.append((i, " ".join(w)))
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.similarity_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i, _ in rows] == components(rows)


def test_similarity_of_hashes_alike(spark):
    """A task holds the n-gram of its first text twice and once another one alike in the upper 40 bits; what comes after it is linked to another task's."""
    texts = ["w3144992", "w3144992 ", "w1291506", "w8", "w8 ", "w9", "w10", None]
    hashes = ngram_join.sets_of(pa.array(texts), 5)[0][[0, 2, 3]]
    assert hashes[0] < hashes[1] < hashes[2] < 1 << 62 and hashes[0] >> np.uint64(24) == hashes[1] >> np.uint64(24)
    rows = spark.sparkContext.parallelize(list(enumerate(texts)), 2)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.similarity_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 3, 4: 3, 5: 5, 6: 6, 7: 7}


def test_lm(spark, docs, texts, empty):
    train = docs.where("doc_id % 5 <> 0")
    for top in (4, 1 << 10):  # with a small table most counts come by join
        model = lm_score.train(train, unigrams=top, bigrams=64, log_bits=16, part_tokens=500, least_parts=2)
        got = {r["doc_id"]: r for r in lm_score.score(docs, model).collect()}
        toks = {i: [*SPACED.findall(low(t)), ""] for i, t in enumerate(texts)}
        c = {}
        for i, ts in toks.items():
            if i % 5:
                for t in ts:
                    c[t] = c.get(t, 0) + 1
        n, v = sum(c.values()), len(c)
        for i, ts in toks.items():
            base = sum(math.log10((c.get(t, 0) + 0.1) / (n + 0.1 * (v + 1))) for t in ts)
            assert got[i]["base_score"] == pytest.approx(base) and got[i]["n_tokens"] == len(ts) and got[i]["n_known"] == sum(t in c for t in ts) and got[i]["score"] < 0
    assert lm_score.score(docs, lm_score.train(empty, log_bits=12)).where("n_known = 0").count() == len(texts)
    assert lm_score.score(empty, model).count() == 0


def test_lm_counts_all_pairs(docs, texts):
    """Every pair of the training texts counts, whatever is broadcast."""
    c, pairs = {}, {}
    toks = {i: [*SPACED.findall(low(t)), ""] for i, t in enumerate(texts)}
    for i, ts in toks.items():
        if i % 5:
            for v, w in zip(["", *ts], ts, strict=False):
                c[w] = c.get(w, 0) + 1
                pairs[v, w] = pairs.get((v, w), 0) + 1
    under = sum(c.values()) + 0.1 * (len(c) + 1)
    q = lambda n: float(lm_score.quantised(np.array([n]))[0])
    p = lambda v, w: (q(pairs.get((v, w), 0)) + 1000 * (c.get(w, 0) + 0.1) / under) / (c.get(v, 0) + 1000)
    for v in list(c)[:20]:
        assert sum(p(v, w) for w in [*c, "unknown"]) == pytest.approx(1, abs=0.02)
    docs = docs.select("doc_id", "text").withColumns({"t1": F.lit("clash"), "copies": F.lit(0), "part": F.lit(1)})
    docs = docs.unionByName(docs.where("doc_id in (0, 3)"))
    for top, bigrams in ((4, 4), (1 << 10, 1 << 10)):
        model = lm_score.train(docs.where("doc_id % 5 <> 0").dropDuplicates(["doc_id"]), unigrams=top, bigrams=bigrams, log_bits=20)
        rows = lm_score.score(docs, model).collect()
        got = {r["doc_id"]: r["score"] for r in rows}
        assert len(rows) == len(texts) + 2
        want = {i: sum(math.log10(p(v, w)) for v, w in zip(["", *ts], ts, strict=False)) for i, ts in toks.items()}
        # false positives only add, and to few texts
        assert all(got[i] > 1.001 * want[i] for i in toks)
        assert sum(got[i] != pytest.approx(want[i], rel=1e-3) for i in toks) <= 2


def test_log_bloom():
    rng = np.random.default_rng(1)
    keys, counts = rng.integers(0, 1 << 63, 2000).astype(np.uint64), rng.integers(1, 10_000, 2000)
    b = lm_score.LogBloom(1 << 20)
    b.add(keys, counts)
    got = b.get(keys)
    assert (got >= counts * 0.8).all() and np.median(got / counts) < 1.1
    assert (b.get(rng.integers(0, 1 << 63, 2000).astype(np.uint64)) > 0).mean() < 0.02


def test_token_counts(docs, texts, empty):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    odd = ["It's 'street 're ''s '", "<|endoftext|> a<|startoftext|>b", "日本語 テスト", "İstanbul ﬁ é", " x\u0085y\x1cz\x0b", "12³½ a_b-c", "don't I'LL we'Ve 'm'd"]
    df = docs.select("doc_id", "text").unionByName(docs.sparkSession.createDataFrame([(1000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    tok = Tokenizer.from_file(path)
    df = df.withColumns({"t1": F.lit("clash"), "n_bytes": F.lit(1)}).unionByName(df.where("doc_id in (2, 1000)"), allowMissingColumns=True)
    for frequent in (5, 1 << 12):
        rows = token_counts.count_tokens(df, path, frequent=frequent).collect()
        got = {r["doc_id"]: r for r in rows}
        assert len(rows) == len(texts) + len(odd) + 2
        for i, t in [*enumerate(texts), *((1000 + i, t) for i, t in enumerate(odd))]:
            assert got[i]["n_tokens"] == len(tok.encode(t or "", add_special_tokens=False)), t
            assert got[i]["n_bytes"] == len((t or "").encode())
    assert token_counts.count_tokens(empty, path).count() == 0


def test_cutter_follows_the_file(tmp_path):
    """A tokenizer with another rule is not cut by the vectorised one."""
    public_tokenizers = pytest.importorskip("public_tokenizers")
    tokenizers = pytest.importorskip("tokenizers")
    assert token_counts.Cutter(str(public_tokenizers.path("word_bpe_49k.json"))).plain
    other = tokenizers.Tokenizer(tokenizers.models.WordLevel({"a": 0, "u": 1}, unk_token="u"))
    other.pre_tokenizer = tokenizers.pre_tokenizers.WhitespaceSplit()
    other.save(str(tmp_path / "t.json"))
    cutter = token_counts.Cutter(str(tmp_path / "t.json"))
    cps, s, e, doc, _ = cutter.cut(pa.array(["a-b c", None, "D's"]))
    assert not cutter.plain and ["".join(map(chr, cps[i:j])) for i, j in zip(s, e, strict=True)] == ["a-b", "c", "D's"] and doc.tolist() == [0, 0, 2]


def _suffixes(x):
    want = sorted(range(len(x)), key=lambda i: x[i:])
    lcp = [0] * len(want)
    for k in range(1, len(want)):
        a, b = x[want[k - 1] :], x[want[k] :]
        lcp[k] = next((i for i, (p, q) in enumerate(zip(a, b, strict=False)) if p != q), min(len(a), len(b)))
    return want, lcp


def test_suffix_array(tmp_path, monkeypatch):
    rng = np.random.default_rng(2)
    for it in range(150):
        t = rng.integers(0, rng.integers(1, 5) + 1, rng.integers(1, 70))
        t = np.concatenate([t, t[: len(t) // 2], t]) if it % 3 == 0 else t
        want, lcp = _suffixes(t.tolist())
        sa, got = _induced.suffix_array(t.astype(np.uint8), 10**6)
        assert sa.tolist() == want and got.tolist() == lcp
        monkeypatch.setattr(_induced, "CHUNK", [3, 8, 1 << 18][it % 3])  # pieces of files end anywhere
        down, pre = _induced.descending(t.astype(np.uint8), 10**6, str(tmp_path), memory=[1, 8, 1000][it % 3], in_memory=2)
        assert down.array()[::-1].tolist() == want and pre.array()[1:][::-1].tolist() == lcp[1:], it


def test_suffix_array_beyond_memory(tmp_path, monkeypatch):
    """A string 64 times the budget: queues spill, names recurse, and the result is that in memory."""
    monkeypatch.setattr(_induced, "CHUNK", 512)
    rng = np.random.default_rng(3)
    t = rng.integers(1, 5, 1 << 14).astype(np.uint16)
    t[9000:9600], t[15000:15600], t[12000:12300] = t[100:700], t[100:700], 1
    tally = _induced.Tally()
    text = np.memmap(tmp_path / "text", np.uint16, "w+", shape=t.shape)
    text[:] = t
    down, pre = _induced.descending(text, 200, str(tmp_path), memory=256, in_memory=256, tally=tally)
    sa, lcp = _induced.suffix_array(t, 200)
    assert tally.levels >= 4 and tally.spilled > len(t)
    assert np.array_equal(pre.array()[1:][::-1], lcp[1:])
    # what shares the first 200 symbols may come in any order
    got = down.array()[::-1]
    runs = np.cumsum(lcp < 200)
    assert np.array_equal(got[np.lexsort((got, runs))], sa[np.lexsort((sa, runs))])


def test_suffix_dedup_shard_beyond_memory():
    rng = random.Random(12)
    p = made(rng, 60, 900)
    parts = [f"{made(rng, 20, 900)} {p} {made(rng, 20, 900)}".encode() for _ in range(40)] + [b"short", p.encode()]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int64()), pa.array([0] * len(parts), pa.int64()), pa.array([7] * len(parts), pa.int64()), pa.array(parts, pa.binary())], ["t1", "t2", "start", "bytes"])
    flags = repeats(parts)
    for memory in (1 << 22, 1 << 10):
        got = [[False] * len(x) for x in parts]
        for rows in suffix_dedup.sort_shard(iter([batch.slice(0, 20), batch.slice(20)]), 200, memory):
            for r in rows.to_pylist():
                for i in range(r["start"] - 7, r["start"] - 7 + r["length"]):
                    got[r["t1"]][i] = True
        assert got == flags


def test_suffix_dedup(spark, docs, texts, empty, monkeypatch):
    rng = random.Random(8)
    p = made(rng, 90, 900)
    more = [p[:250] + "1" + p[:260], "é" * 180, "ab" * 300, p[100:420], "q" + p[100:420] + "z", p[50:300] + p[60:310]]
    all_ = [*texts, *more]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(more)], "doc_id long, text string"))
    keys = [*range(len(texts)), *(1000 + i for i in range(len(more)))]
    raw = [(t or "").encode() for t in all_]
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(df).collect()}
    for key, t, gone in zip(keys, raw, repeats(raw), strict=True):
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        assert (got[key]["n_bytes"], got[key]["n_removed"], got[key]["n_spans"], got[key]["kept_sha256"]) == (len(t), sum(gone), runs, sha(kept)), key
        assert bytes(got[key]["kept"]) == kept
    assert suffix_dedup.remove_repeats(empty).count() == 0
    monkeypatch.setattr(suffix_dedup, "PIECE", 512)  # long texts come in overlapping pieces
    t = np.frombuffer(raw[0] * 3, np.uint8)
    s = suffix_dedup.stretches(t, np.array([0, len(t)]))
    assert s["windows"].sum() == len(t) - 199


def test_suffix_dedup_one_copy(spark, monkeypatch):
    """Many copies of a text and one near copy: each stretch goes to its shard once."""
    base = made(random.Random(9), 120, 400)
    at = base.index(" ", 300)
    all_ = [base] * 30 + [f"{base[:at]} changed{base[at:]}"]
    df = spark.createDataFrame(list(enumerate(all_)), "doc_id long, text string").repartition(3)
    dealt, plain = [], type(df).repartition

    def counted(self, n, *by):
        if by == ("anchor",):
            dealt.append((self.count(), self.select("anchor", "t1", "t2", "start").distinct().count()))
        return plain(self, n, *by)

    monkeypatch.setattr(type(df), "repartition", counted)
    got = {r["doc_id"]: r["kept"] for r in suffix_dedup.remove_repeats(df).collect()}
    assert dealt and all(n == one > 0 for n, one in dealt)
    raw = [t.encode() for t in all_]
    for i, (t, gone) in enumerate(zip(raw, repeats(raw), strict=True)):
        assert bytes(got[i]) == bytes(b for b, g in zip(t, gone, strict=True) if not g)


def test_language(spark, empty):
    rng = random.Random(4)
    voc = {"en": ["the", "and", "with", "thing"], "de": ["und", "der", "schön", "ung"], "fr": ["est", "que", "très", "eau"], "es": ["que", "los", "ción", "ñor"]}
    rows = [(i, " ".join(rng.choice(voc[x]) for _ in range(rng.randrange(10, 80))), x) for i, x in enumerate(rng.choice(list(voc)) for _ in range(300))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = lang_id.train(df.where("doc_id % 4 <> 2"))
    assert set(m.members) == {"germanic", "romance"} and set(m.pairs) == {"germanic", "romance"}
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "12 %%", "x"), (4, "é", "x")], "doc_id long, text string, score string")
    got = {r["doc_id"]: r for r in lang_id.identify(odd, m).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and got[4]["lang_pred"] in voc and got[1]["score"] == 0
    held = lang_id.identify(df.where("doc_id % 4 = 2"), m)
    assert held.where("lang_pred = lang").count() >= 0.97 * held.count() and held.where("score between 0 and 1").count() == held.count()
    none = lang_id.train(df.limit(0))
    assert lang_id.identify(df.limit(3), none).where("lang_pred = 'und'").count() == 3
    one = lang_id.train(df.where("lang = 'fr'"))
    assert lang_id.identify(df.limit(3), one).where("lang_pred = 'fr' and score = 1").count() == 3


def test_topk(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 6)).round(2)
    x[50:60] = x[0]
    rows = [(int(i), [float(v) for v in x[i]], "a") for i in range(300)]
    bad = [(1000, None, ""), (1100, [1.0, None], ""), (1200, [float("nan")] * 6, ""), (1300, [float("inf")] * 6, ""), (1400, [], ""), (1500, [0.0] * 6, "")]
    df = spark.createDataFrame([*rows, *bad], "vec_id long, embedding array<double>, score string")
    got = topk.top_k(df, F.col("vec_id") % 100 == 0, k=7, block_rows=32, query_bytes=200)
    out = {}
    for r in got.collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    v = {i: np.floor(1024 * np.array(e)).astype(int) for i, e, _ in rows} | {1400: np.zeros(6, int), 1500: np.zeros(6, int)}
    assert set(out) == {0, 100, 200, 1400, 1500}
    for q, found in out.items():
        want = sorted(((-int(v[q] @ v[i]), i) for i in v if i != q))[:7]
        assert sorted(found) == [(k + 1, i, -s) for k, (s, i) in enumerate(want)]
    b = topk.Block(np.arange(4096), np.abs(rng.normal(size=(4096, 3)) * 1024).astype(np.int64))
    assert b.search(b.vectors[0], -1, 5, np.zeros(0, np.int64), np.zeros(0, np.int64))[2] < 4096
    assert topk.top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_sharding(spark, docs, texts, empty, monkeypatch):
    monkeypatch.setattr(sharding, "RANKED", 3)
    df = docs.unionByName(docs.where("doc_id < 5")).withColumns({"shard": F.lit("x"), "bucket": F.lit(1)})
    out = sharding.assign(df, 4)
    rows = out.collect()
    assert len(rows) == len(texts) + 5
    slots = {}
    for r in rows:
        t = texts[r["doc_id"]]
        assert r["size"] == len((t or "").encode()) + 16 and r["text_crc32"] == (None if t is None else zlib.crc32(t.encode()))
        assert r["grown_shard"] in (r["shard"], 4) and 0 <= r["shard"] < 4 and r["bucket"] == 1
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    one = spark.range(5000).select(F.struct(*sharding.jump(F.col("id"), 100)).alias("j")).select("j.*").toPandas()
    assert one.col1.value_counts().between(20, 90).all() and 0.003 < (one.col1 != one.col2).mean() < 0.02
    assert sharding.assign(empty, 4).count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
