"""Relational operators on small tables, against loops where a loop is the definition."""

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from webstrata.functions import html
from webstrata.operators import events, fields, links, lookups, metrics, ranking, snapshots, timing, walks
from webstrata.sources import files


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_links(spark):
    page = '<a href="/a">1</a><a HREF = \'b?x#f\'>2</a><a href="#z"></a><a href="mailto:q"></a><a href="/a#g"></a><link href="http://o.x/s"><a href="https://sub.h.x/t">'
    df = spark.createDataFrame([(1, "https://h.x/d/p", page), (2, "https://h.x/", None)], "page_id int, url string, html string")
    assert rows(links.extract_links(df), "pos") == [(1, 0, "https://h.x/a"), (1, 1, "https://h.x/d/b?x")]
    assert rows(links.extract_links(df, in_python=True, cap=1), "pos") == [(1, 0, "https://h.x/a")]
    assert len(rows(links.extract_links(df, wide=True, exclude=["/a$"]), "pos")) == 2
    assert rows(links.offsite_count(df), "page_id") == [(1, 2)]
    maps = spark.createDataFrame([("r", "<sitemapindex><loc>https://h/1</loc><loc>https://h/2</loc><loc>https://o/3</loc>"), ("https://h/1", "<loc>https://h/a</loc><loc>https://z/b</loc>"), ("https://h/2", "<loc>https://h/a</loc><loc>https://h/c</loc>")], "url string, xml string")
    assert [r[0] for r in rows(links.seed_sitemap(maps, "r", "h"), "part", "pos")] == ["https://h/a", "https://h/c"]


def test_ranking(spark):
    df = spark.createDataFrame([("cats dogs", "Cats here", "http://x.com", 1), ("cats dogs", "Cats here", "https://a.b.c.gov", 2), ("", "x", "https://en.wikipedia.org/", 3)], "q string, t string, u string, p int")
    got = [r[0] for r in df.select(ranking.score(F.col("q"), F.col("t"), F.col("u"), F.col("p"), prefer=["c.gov"])).collect()]
    assert got == pytest.approx([0.6, 0.5 + 0.3 + 0.2 + 0.4 - 0.1 + 0.05, 0.3 + 0.2 + 0.1 / 3])
    assert ranking.hints(["a"], "docs")[-1] == "a" and ranking.hints(None, "none") == []
    b = spark.createDataFrame([("g", i, 40) for i in range(4)], "g string, i int, n int")
    assert [r["i"] for r in ranking.budget(b, ["g"], "i", "n", pages=9, chars=100).orderBy("i").collect()] == [0, 1, 2]
    assert ranking.budget(b, ["g"], "i", "n", pages=2, chars=1000).count() == 2
    s = spark.createDataFrame([("g", i, i == 2) for i in range(5)], "g string, i int, bad boolean")
    assert [r["state"] for r in ranking.skip_after_failure(s, ["g"], "i", F.col("bad")).orderBy("i").collect()] == ["ok", "ok", "failed", "skipped", "skipped"]
    assert [r["i"] for r in ranking.last_n(s, ["g"], "i", 2).orderBy("i").collect()] == [3, 4]
    assert [r["i"] for r in ranking.keep_recent(b, ["g"], [F.desc("i")], "n", 90).orderBy("i").collect()] == [2, 3]


def test_metrics(spark):
    k = spark.sql("select map('b', '2', 'a', '1') as m, cast(null as map<string,string>) as n")
    assert k.select(metrics.series_key(F.lit("x"), F.col("m")), metrics.series_key(F.lit("x"), F.col("n"))).first()[:] == ("x{a=1,b=2}", "x")
    rng = random.Random(2)
    calls = [("n", f"k{rng.randrange(9)}", i, 1) for i in range(60)]
    got = {r["key"]: r["total"] for r in metrics.counters(metrics.cap_series(spark.createDataFrame(calls, "name string, key string, seq int, value int"), "name", "key", "seq", 3)).collect()}
    seen, want = set(), {}
    for n, key, _, v in calls:
        if key not in seen and len(seen) >= 3:
            key = f"{n}{{__overflow__=_other}}"
        else:
            seen.add(key)
        want[key] = want.get(key, 0) + v
    assert got == want
    h = lambda *s: metrics.health(spark.createDataFrame([(x,) for x in s], "status string")).first()[0]
    assert (h("pass", "skip"), h("warn", "pass"), h("warn", "fail")) == ("healthy", "usable_with_warnings", "unusable")


def test_rate_limits(spark):
    a = spark.createDataFrame([("h", i, t) for i, t in enumerate([0.0, 0.0, 0.1, 5.0])], "g string, event_id int, at double")
    assert [r["granted"] for r in timing.rate_limit(a, "g", "at", F.lit(0.5)).orderBy("event_id").collect()] == [0, 0.5, 1.0, 5.0]
    rng = random.Random(3)
    calls = sorted((f"g{rng.randrange(3)}", round(rng.random() * 30, 2), rng.choice([200, 200, 429]), rng.choice([None, 3.0, 900.0])) for _ in range(80))
    calls = [(None if g == "g2" else g, *rest) for g, *rest in calls]  # a null group is a group
    df = spark.createDataFrame([(*c, i) for i, c in enumerate(calls)], "g string, at double, status int, retry_after double, event_id int")
    got = [tuple(r) for r in timing.rate_limit_with_backoff(df, "g", "at", gap=0.5, most=10).select("event_id", "g", "at", "granted").orderBy("event_id").collect()]
    want, free = [], {}
    for g, t, status, wait in calls:
        at = max(t, free.get(g, float("-inf")))
        free[g] = at + 0.5
        if status == 429:
            free[g] = max(free[g], at + min(max(wait or 0, 1.0), 10))
        want.append((len(want), g, t, at))
    assert got == want


def test_breaker_sessions_asof(spark):
    c = spark.createDataFrame([("g", float(t), bad, i) for i, (t, bad) in enumerate([(0, True), (10, False), (60, True), (100, False), (121, False), (122, True)])], "g string, at double, trip boolean, event_id long")
    assert [r["allowed"] for r in timing.circuit_breaker(c, "g", "at", trips="trip", cooldown=60).orderBy("event_id").collect()] == [True, False, True, False, True, True]
    c = spark.createDataFrame([(None, 0.0, True, 1), (None, 10.0, False, 2), (None, 10.0, True, 3)], "g long, at double, trip boolean, event_id long")
    assert [r["allowed"] for r in timing.circuit_breaker(c, "g", "at", trips="trip", cooldown=60).orderBy("event_id").collect()] == [True, False, False]
    e = spark.createDataFrame([("u", t) for t in (0, 10, 20, 31)], "u string, at long")
    assert rows(timing.idle_sessions(e, "u", "at", 10), "session") == [("u", 0, 0, 20, 3), ("u", 1, 31, 31, 1)]
    left = spark.createDataFrame([("k", 5, 1), ("k", 50, 2), ("j", 5, 3)], "k string, at long, id int")
    right = spark.createDataFrame([("k", 5, "a"), ("k", 9, "b")], "k string, at long, v string")
    assert [(r["id"], r["v"]) for r in timing.asof(left, right, "k", "at", "v", 30).orderBy("id").collect()] == [(1, "a"), (2, None), (3, None)]
    h = spark.createDataFrame([("p", i, x) for i, x in enumerate([1, 2, 2, 2, 3, 3])], "p string, i int, h int")
    assert rows(timing.exhausted(h, "p", "i", "h", 2, 99), "p") == [("p", 3)]
    assert rows(timing.settled(spark.createDataFrame([("p", 0, 0.9), ("p", 1, None)], "p string, i int, c double"), "p", "i", "c", 0.7), "p") == [("p", 1)]


def test_snapshots(spark):
    pages = spark.createDataFrame([("https://u", "a\r\nb\n", 1), ("https://u", "a\nb", 2), ("https://u", "a\nc\nd", 3)], "url string, content string, captured_at int")
    d = snapshots.diff(snapshots.versions(snapshots.snapshots(pages))).orderBy("captured_at").collect()
    assert [r["changed"] for r in d] == [True, False, True] and d[0]["summary"] == "first snapshot, 2 lines" and d[2]["added"] == ["c", "d"] and d[2]["removed"] == ["b"]
    assert snapshots.latest(snapshots.snapshots(pages)).first()["captured_at"] == 3
    assert snapshots.compare("x\ny", "x\nz", 1)[5] is False


def test_snapshots_of_whole_texts(spark, tmp_path):
    from webstrata.plans.queries import QUERIES

    rows = [(4, "a" * 500 + "\nold"), (5, "a" * 500 + "\nnew")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    d = QUERIES["q_snapshot_diff"](spark, str(tmp_path)).orderBy("captured_at").collect()
    assert d[1]["changed"] and d[1]["added"] == ["new"] and d[1]["removed"] == ["old"]
    assert QUERIES["q_latest_snapshot"](spark, str(tmp_path)).first()["captured_at"] == 5


def test_fields(spark):
    page = '<script type="application/ld+json">{"name": "N", "offers": {"price": "1,200.50"}}</script><meta property="og:title" content="OG"><dl><dt>Price Match Guarantee</dt><dd>yes</dd><dt>Maker</dt><dd> </dd><dt>Manufacturer</dt><dd>ACME</dd></dl>'
    p = html.with_signals(spark.createDataFrame([(1, page), (2, "<dl><dt>Price Match Guarantee</dt><dd>yes</dd></dl>")], "id int, html string"))
    asked = fields.schema_table(spark, {"price": "", "brand": "", "title": "", "weight": ""})
    got = {(r["id"], r["field"]): (r["value"], r["number"], r["source"]) for r in fields.resolve(p, asked, "id").collect()}
    assert got[1, "price"] == ("1,200.50", 1200.5, "json-ld") and got[1, "brand"] == ("ACME", None, "dom") and got[1, "title"] == ("N", None, "json-ld")
    assert got[1, "weight"] == (None, None, None) and got[2, "price"] == (None, None, None)
    filled = fields.with_extractor(fields.resolve(p, asked, "id"), p, "id", "html", lambda f, c: F.when(f == "weight", "3"))
    assert filled.where("source = 'llm'").count() == 2 and filled.count() == 8


def test_lookups(spark):
    r = spark.createDataFrame([(1, "a.b.c"), (2, "x")], "id int, host string")
    t = spark.createDataFrame([("c", 1), ("b.c", 2), ("xb.c", 3)], "domain string, v int")
    assert rows(lookups.longest_suffix(r, t, "id", "host", "domain").select("id", "domain", "v"), "id") == [(1, "b.c", 2)]
    a = spark.createDataFrame([("k", 1), ("l", 1)], "k string, v int")
    assert rows(lookups.override(a, a.where("k = 'k'").withColumn("v", F.lit(2)), keys=["k"]), "k") == [("k", 2), ("l", 1)]


def test_walks(spark):
    rng = random.Random(7)
    edges = [(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}", i) for i in range(160)]
    lk = spark.createDataFrame(edges, "src string, dst string, pos int")
    start = spark.createDataFrame([("n0",)], "url string")
    for most, deep in ((12, 9), (100, 2), (100, 9)):
        got, why = walks.crawl(lk, start, max_pages=most, max_depth=deep)
        seen, queue = ["n0"], [("n0", 0)]
        while queue:
            u, d = queue.pop(0)
            for s, t, _ in edges:
                if s == u and t not in seen and d < deep and len(seen) < most:
                    seen.append(t)
                    queue.append((t, d + 1))
        assert [r["url"] for r in got.orderBy("rank").collect()] == seen and why == ("max_pages" if most == 12 else "max_depth" if deep == 2 else "frontier_empty")
    pages = spark.createDataFrame([("a", "b", "1"), ("b", "a", "2"), ("c", "d", "3"), ("d", None, "3"), ("e", None, "4")], "url string, next_url string, hash string")
    out = walks.collect_pages(pages, spark.createDataFrame([(1, "a"), (2, "c"), (3, "e"), (4, "zz")], "walk int, url string"))
    assert {r["walk"]: (r["step"], r["stop"]) for r in out.where("stop is not null").collect()} == {1: (3, "cycle"), 2: (2, "cycle"), 3: (1, "no_next"), 4: (1, "error")}


def test_events(spark):
    tr = spark.createDataFrame([(0, {"value": "***REDACTED***"}), (1, {"value": "***REDACTED***"}), (2, {"x": "y"})], "ordinal int, args map<string,string>")
    got = events.replay(tr, spark.createDataFrame([(0, "s")], "ordinal int, value string")).orderBy("ordinal").collect()
    assert [(r["ordinal"], r["args"]) for r in got] == [(0, {"value": "s"}), (2, {"x": "y"})]
    g = events.gate_actions(spark.createDataFrame([(1, "click"), (1, "evaluate"), (2, "click")], "s int, action string"), "s", ["evaluate"])
    assert [r["state"] for r in g.orderBy("s").collect()] == ["skipped", "skipped", "ready"]


def _zip(**parts):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for k, v in parts.items():
            z.writestr(k.replace("__", "/"), v)
    return b.getvalue()


def test_files(spark, tmp_path):
    w, s, r = files._W[1:-1], files._S[1:-1], files._R[1:-1]
    docx = _zip(**{"word__document.xml": f'<d xmlns="{w}"><body><p><r><t>Hi</t></r></p><p/><tbl><tr><tc><p><t>a</t></p></tc><tc><p><t>b</t></p></tc></tr></tbl></body></d>'})
    xlsx = _zip(
        **{
            "xl__workbook.xml": f'<w xmlns="{s}" xmlns:r="{r}"><sheets><sheet name="S" r:id="x1"/></sheets></w>', "xl___rels__workbook.xml.rels": '<R><Relationship Id="x1" Target="worksheets/s.xml"/></R>',
            "xl__sharedStrings.xml": f'<sst xmlns="{s}"><si><t>name</t></si></sst>', "xl__worksheets__s.xml": f'<x xmlns="{s}"><row><c t="s"><v>0</v></c><c><v>5</v></c></row><row><c/></row></x>',
        }
    )
    df = spark.createDataFrame([("csv", b"\xef\xbb\xbfa;b\r\n;\r\ncaf\xc3\xa9;2"), ("csv", "café,1\nx,2".encode("latin-1")), ("docx", docx), ("xlsx", xlsx), ("docx", b"no"), ("zip", b"x"), ("csv", None)], "kind string, content binary")
    got = [tuple(x) for x in files.extract_files(df).collect()]
    assert [x[1] for x in got[:4]] == ["a\tb\ncafé\t2", "café\t1\nx\t2", "Hi\n# Table\na\tb", "# Sheet: S\nname\t5"]
    assert [x[2] for x in got[4:]] == ["none"] * 3 and got[4][3].startswith("BadZipFile")
    (tmp_path / "t.jsonl").write_text('{"a": 1}\nbroken\n{"a": 2}\n')
    assert files.json_lines(spark, str(tmp_path / "t.jsonl"), "a int").count() == 2
    skill = "---\nname: n\ndomain: X.com\ndescription: d\n---\n## Recommended flow\n1. go\n2. stop\n"
    assert files.skill_file(skill)["flow"] == ["go", "stop"] and files.skill_file("nothing") is None
