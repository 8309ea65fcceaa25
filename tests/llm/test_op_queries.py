"""Every query of the training-data operators on the smallest data folder, against its SQL or a plain statement of its rule."""

import math
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from brute import SPACED, low, repeats, sha

from webstrata.llm import mixing
from webstrata.llm.queries import QUERIES, SQL
from webstrata.sources.session import ship_code

FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no data folder")


@pytest.fixture(scope="module")
def docs(spark):
    ship_code(spark)
    return [r.asDict() for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]


def found(spark, name):
    return {r["doc_id"]: r.asDict() for r in QUERIES[name](spark, str(FOLDER)).collect()}


def crc(x):
    return zlib.crc32(str(x).encode())


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    ship_code(spark)
    c = duckdb.connect()
    for f in FOLDER.glob("*.parquet"):
        c.execute(f"create view {f.stem} as select * from read_parquet('{f}')")
    df = QUERIES[name](spark, str(FOLDER))
    out = c.execute(SQL[name])
    names = [d[0] for d in out.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(str, map(tuple, df.select(*names).collect()))) == sorted(str(tuple(r)) for r in out.fetchall())


def test_op3(spark, docs):
    got = found(spark, "op3_mix_sources")
    size = {d["doc_id"]: len(SPACED.findall(d["text"] or "")) for d in docs}
    sources = sorted({d["source"] for d in docs}, key=lambda x: (x is None, x or ""))
    total = {s: sum(size[d["doc_id"]] for d in docs if d["source"] == s) for s in sources}
    want = dict(zip(sources, mixing.targets([total[s] for s in sources]), strict=True))
    assert sum(want.values()) == pytest.approx(min(1.5, 2) * sum(total.values()))
    took = Counter()
    for d in docs:
        r = got[d["doc_id"]]
        assert (r["size"], r["source_size"]) == (size[d["doc_id"]], total[d["source"]]) and r["target"] == pytest.approx(want[d["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        took[d["source"]] += r["taken"]
    assert all(took[s] == math.floor(want[s] + 1e-6) for s in sources)


def test_op5(spark, docs):
    got = found(spark, "op5_lm_score")
    toks = {d["doc_id"]: [*SPACED.findall(low(d["text"])), None] for d in docs}
    c = Counter(t for i, ts in toks.items() if crc(i) % 10 for t in ts)
    n, v = sum(c.values()), len(c)
    for i, ts in toks.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (crc(i) % 10 == 0, len(ts), sum(t in c for t in ts), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in ts)) and r["score"] < 0


def test_op6(spark, docs):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    got = found(spark, "op6_token_counts")
    for d in docs:
        n = len(tok.encode(d["text"] or "", add_special_tokens=False))
        r = got[d["doc_id"]]
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((d["text"] or "").encode()), n, n > 2048)


def test_op7(spark, docs):
    got = found(spark, "op7_suffix_dedup")
    raw = [(d["text"] or "").encode() for d in docs]
    for d, t, gone in zip(docs, raw, repeats(raw), strict=True):
        r = got[d["doc_id"]]
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(t), sum(gone), runs, sha(bytes(b for b, g in zip(t, gone, strict=True) if not g)))


def test_op8(spark, docs):
    got = found(spark, "op8_language_id")
    right = []
    learnt = {d["lang"] for d in docs if d["lang"] and crc(d["doc_id"]) % 4 != 2}
    for d in docs:
        r = got[d["doc_id"]]
        assert r["held_out"] == (crc(d["doc_id"]) % 4 == 2) and 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not re.search(r"[^\W\d_]", d["text"] or "")) and r["lang_pred"] in learnt | {"und"}
        if r["held_out"] and d["lang"] and r["lang_pred"] != "und":
            right.append(r["lang_pred"] == d["lang"])
    assert sum(right) >= 0.95 * len(right) > 0


def test_op10(spark, docs):
    got = found(spark, "op10_sharding")
    slots = defaultdict(list)
    for d in docs:
        r, raw = got[d["doc_id"]], (d["text"] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 16, zlib.crc32(raw), "key") and 0 <= r["shard"] < 40
        assert r["grown_shard"] in (r["shard"], 40)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(got) == len(docs)
