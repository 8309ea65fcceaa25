"""Queries over small tables of literals: rules whose every case is spelled out, with the wanted results as SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from webstrata.functions import detect, safety, urls
from webstrata.functions import text as tx
from webstrata.operators import lookups, metrics, ranking, routing, timing, walks
from webstrata.plans.registry import query


def _sql(x: object) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, float):
        return f"CAST({x!r} AS DOUBLE)"
    return str(x) if isinstance(x, int) else "'" + str(x).replace("'", "''") + "'"


def values(columns: str, rows: list[tuple]) -> str:
    """SQL for rows of literals."""
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_sql, r)) + ')' for r in rows)}) t({columns})"


# Bodies, status, and what is found: each marker of each vendor once, alone in a long page unless told otherwise.
_LONG = "<p>" + "plain words of a page " * 60 + "</p>"
_WALLS = [
    *[(f"<i>{m}</i>{_LONG}", 200, "cloudflare", "js_challenge", 0.85) for m in ("cf-chl-", "/cdn-cgi/challenge-platform/", "window._cf_chl_opt")],
    (f"<title>Just a moment...</title>{_LONG}", 200, "cloudflare", "js_challenge", 0.85),
    ("<title>Just a moment...</title><i>/cdn-cgi/challenge-platform/</i>", 503, "cloudflare", "js_challenge", 0.98),
    *[(f"<i>{m}</i>{_LONG}", 200, "cloudflare", "captcha", 0.5) for m in ("cf-turnstile", "challenges.cloudflare.com")],
    ("<i class='cf-turnstile'></i>", 200, "cloudflare", "captcha", 0.75),
    ("<i class='cf-turnstile'></i>", 403, "cloudflare", "captcha", 0.85),
    *[(f"<i>{a}</i><i>{b}</i>{_LONG}", 200, "cloudflare", "block_page", 0.88) for a in ("You have been blocked", "<title>Attention required") for b in ("cf-error-details", "cf-wrapper", "Cloudflare Ray ID", "cf-ray")],
    *[(f"<i>{m}</i>{_LONG}", 200, "datadome", "captcha", 0.85) for m in ("geo.captcha-delivery.com", "captcha-delivery.com", "ddjskey")],
    *[(f"<i>{m}</i>{_LONG}", 200, "akamai", "js_challenge", 0.85) for m in ("/_sec/cp_challenge/", "ak-challenge", "sec-cpt-")],
    *[(f"<i>{m}</i>{_LONG}", 403, "perimeterx", "captcha", 0.95) for m in ("px-captcha", "_pxAppId", "captcha.px-cdn.net")],
    (f"<i>px-captcha</i>{_LONG}", 429, "perimeterx", "rate_limit", 0.95),
    *[(f"<i>{m}</i>{_LONG}", 403, "generic", "captcha", 0.9) for m in ("hcaptcha.com/1/api.js", "google.com/recaptcha/api.js", "recaptcha.net/recaptcha/api.js", "google.com/recaptcha/enterprise.js")],
    (f"<i>google.com/recaptcha/api.js</i>{_LONG}", 200, None, None, None),
    *[(f"<title>{t}</title>", 403, "unknown", "block_page", 0.55) for t in ("Access denied", "Verifying you are human", "Bot detection", "Security check", "Are you a robot", "Pardon our interruption", "Access to this page has been denied")],
    ("<title>Access denied</title>", 200, None, None, None),
    ("<title>News</title>", 403, None, None, None),
    (_LONG, 429, None, None, None),
]


@query("q_challenge_detect", values("n, vendor, kind, confidence", [(i, v, k, c) for i, (_, _, v, k, c) in enumerate(_WALLS)]))
def q_challenge_detect(spark, sf):
    rows = spark.createDataFrame([(i, b, s) for i, (b, s, *_) in enumerate(_WALLS)], "n int, html string, status int")
    c = detect.challenge(F.col("html"), F.col("status"), F.lit(None).cast("map<string,string>"), F.lit("https://a.example/"))
    return rows.select("n", c.alias("c")).select("n", "c.vendor", "c.kind", "c.confidence")


_AMOUNTS = [
    ("12", 12.0), (" 1,234.50 ", 1234.5), ("-7", -7.0), ("0.5", 0.5), ("0", 0.0), ("+49 30", None), ("+5", None), ("007", None), ("1234567890123456", None), ("123456789012345", 123456789012345.0), ("1,23", None), ("12 kg", None), ("", None), ("abc", None),
]


@query("q_value_coerce", values("given, text_value, number_value", [(a, a.strip(), b) for a, b in _AMOUNTS]))
def q_value_coerce(spark, sf):
    t, n = tx.coerce(F.col("given"))
    return spark.createDataFrame([(a,) for a, _ in _AMOUNTS], "given string").select("given", t.alias("text_value"), n.alias("number_value"))


_KEYS = ["password", "PASSWD", "auth_token", "client_secret", "api_key", "apikey", "Credential", "authorization", "cookie", "session_id", "bearer", "access", "private"]


@query("q_redact_map", values("name, shown", [*((k, tx.REDACTED) for k in _KEYS), ("user", "x"), ("url", "x"), ("page", "x")]))
def q_redact_map(spark, sf):
    rows = spark.createDataFrame([(k,) for k in [*_KEYS, "user", "url", "page"]], "name string")
    return rows.select("name", F.element_at(tx.redact_map(F.create_map(F.col("name"), F.lit("x"))), F.col("name")).alias("shown"))


_NESTED = [
    ('{"a": 1, "login": {"password": "p", "user": "u"}}', '{"a": 1, "login": {"password": "***REDACTED***", "user": "u"}}'),
    ('{"token": {"x": 1}, "rows": [{"api_key": "k", "n": [1, {"secret": 2}]}]}', '{"token": "***REDACTED***", "rows": [{"api_key": "***REDACTED***", "n": [1, {"secret": "***REDACTED***"}]}]}'),
    ("[1]", "{}"), ("broken", "{}"), (None, "{}"), ('{"é": "ü"}', '{"é": "ü"}'),
]


@query("q_redact_json", values("n, shown", [(i, b) for i, (_, b) in enumerate(_NESTED)]))
def q_redact_json(spark, sf):
    rows = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(_NESTED)], "n int, given string")
    return rows.select("n", safety.redact_json(F.col("given")).alias("shown"))


_ERRORS = [
    ("RatelimitException", "x", True, False), ("MyRateLimitError", None, True, False), ("ValueError", "202 Ratelimit", True, False), ("E", "Rate limit reached", True, False), ("Timeout", "slow", False, False),
    ("Error", "Unable to retrieve content because the page is navigating and changing the content", False, True), (None, None, False, False),
]


@query("q_error_signals", values("n, limited, race", [(i, a, b) for i, (_, _, a, b) in enumerate(_ERRORS)]))
def q_error_signals(spark, sf):
    rows = spark.createDataFrame([(i, e, m) for i, (e, m, *_) in enumerate(_ERRORS)], "n int, error string, message string")
    return rows.select("n", detect.rate_limited(F.col("error"), F.col("message")).alias("limited"), detect.navigation_race(F.col("message")).alias("race"))


_SERPS = [
    ("google", "https://g.example/sorry/index", "", True), ("google", "https://g.example/?Captcha=1", "", True), ("google", "https://g.example/", '<form id="captcha-form">', True), ("google", "https://g.example/", "<div class=a id=recaptcha>", True),
    ("google", "https://g.example/", '<iframe title=x src="https://x/recaptcha/a">', True), ("google", "https://g.example/", "<p>anomaly in your network</p>", False), ("duckduckgo", "https://d.example/anomaly.js", "", True),
    ("duckduckgo", "https://d.example/", '<form method=post id="challenge-form">', True), ("duckduckgo", "https://d.example/", '<input type=hidden name="anomaly_token">', True), ("duckduckgo", "https://d.example/", "<body>Unfortunately, bots use it too", True),
    ("duckduckgo", "https://d.example/", "<p>If this error persists</p>", True), ("duckduckgo", "https://d.example/", "<p>" + "word " * 200 + "anomaly in your</p>", False), ("duckduckgo", "https://d.example/", "<p>results</p>", False),
]


@query("q_search_refused", values("n, refused", [(i, r) for i, (*_, r) in enumerate(_SERPS)]))
def q_search_refused(spark, sf):
    rows = spark.createDataFrame([(i, e, u, h) for i, (e, u, h, _) in enumerate(_SERPS)], "n int, engine string, url string, html string")
    return rows.select("n", detect.search_refused(F.col("url"), F.col("html"), F.col("engine")).alias("refused"))


@query("q_profile_hints", values("profile, n, first, last", [("official_sources", 16, "ec.europa.eu", "mine.example"), ("docs", 12, "docs.python.org", "mine.example"), ("research", 12, "arxiv.org", "mine.example"), ("news", 12, "reuters.com", "mine.example"), ("files", 12, "sec.gov", "mine.example"), ("none", 1, "mine.example", "mine.example")]))
def q_profile_hints(spark, sf):
    rows = [(p, ranking.hints(["mine.example"], p)) for p in ("official_sources", "docs", "research", "news", "files", "none")]
    df = spark.createDataFrame(rows, "profile string, hints array<string>")
    return df.select("profile", F.size("hints").alias("n"), F.element_at("hints", 1).alias("first"), F.element_at("hints", -1).alias("last"))


_FILES = [
    ("a", 1, "https://x.example/page.html", None), ("a", 2, "https://x.example/data", "pdf"), ("a", 3, "https://x.example/r.PDF?x=1", None), ("a", 4, "https://x.example/s.pdf", None),
    ("b", 1, "https://x.example/t.xlsx", None), ("b", 2, "https://x.example/u", "xlsx"), ("b", 3, "https://x.example/v", "pdf"), ("c", 1, "https://x.example/w.zip", None), ("d", 1, "http://10.0.0.1/z.pdf", None), ("d", 2, "https://bad.example/z.pdf", None),
]


@query("q_first_file", values("query, url, tier", [("a", "https://x.example/r.PDF?x=1", 1), ("b", "https://x.example/v", 2)]))
def q_first_file(spark, sf):
    rows = spark.createDataFrame(_FILES, "query string, position int, url string, probed string")
    return routing.first_file(rows, "query", ["pdf"], probed="probed", deny=["bad.example"])


@query("q_routed_scan", "SELECT CASE WHEN p % 4 = 0 THEN 'binary' ELSE 'html' END AS route, count(*) AS n FROM (SELECT page_id AS p FROM pages) GROUP BY 1")
def q_routed_scan(spark, sf):
    from webstrata.sources.tables import table

    p = table(spark, sf, "pages").select("page_id", "url", "html", F.when(F.col("page_id") % 4 == 0, "application/pdf").otherwise("text/html; charset=utf-8").alias("content_type"))
    u = F.concat(F.lit("https://x.example/"), F.col("page_id").cast("string"))
    read = routing.routed_scan(p.withColumn("url", u), lambda r: r.select("page_id", "route", F.length("html").alias("bytes")), lambda r: r.select("page_id", "route", detect.title_of(F.col("html")).alias("title")), content_type="content_type")
    return read.groupBy("route").agg(F.count(F.lit(1)).alias("n"))


_COOKIES = [("s", "1", ".bank.example", True), ("t", "2", "bank.example", False), ("u", "3", "shop.example", False), ("v", "4", None, False), ("w", "5", "example", False), ("x", "6", "www.bank.example", None)]


@query(
    "q_cookies_for",
    values(
        "id, name, domain",
        [(1, "s", "bank.example"), (1, "t", "bank.example"), (1, "v", "www.bank.example"), (1, "w", "example"), (1, "x", "www.bank.example"), (2, "t", "bank.example"), (2, "v", "bank.example"), (2, "w", "example"), (3, "v", "notbank.example"), (3, "w", "example")],
    ),
)
def q_cookies_for(spark, sf):
    rows = spark.createDataFrame([(1, "https://www.bank.example/a"), (2, "http://bank.example/"), (3, "https://notbank.example/"), (4, "mailto:x")], "id int, url string")
    return lookups.cookies_for(rows, spark.createDataFrame(_COOKIES, "name string, value string, domain string, secure boolean"), "id").select("id", "name", "domain")


@query("q_canonical_host", values("host, short, good", [("2001:db8:0:0:0:0:0:1", "2001:db8::1", True), ("FE80::0001", "fe80::1", True), ("a.example", "a.example", True), ("x" * 64 + ".example", "x" * 64 + ".example", False), ("bücher.example", "bücher.example", True), ("ü" * 70, "ü" * 70, False), ("a..b", "a..b", False), ("", "", False)]))
def q_canonical_host(spark, sf):
    hosts = ["2001:db8:0:0:0:0:0:1", "FE80::0001", "a.example", "x" * 64 + ".example", "bücher.example", "ü" * 70, "a..b", ""]
    h = F.col("host")
    return spark.createDataFrame([(x,) for x in hosts], "host string").select("host", safety.canonical_host(h).alias("short"), safety.encodable(h).alias("good"))


@query("q_agent_family", values("agent, family", [("Mozilla/5.0 (Windows NT 10.0; Win64; x64)", "windows"), ("Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7)", "macos"), ("Mozilla/5.0 (X11; Linux x86_64)", "linux"), ("Mozilla/5.0 (Linux; Android 14)", "linux"), ("curl/8", None)]))
def q_agent_family(spark, sf):
    agents = ["Mozilla/5.0 (Windows NT 10.0; Win64; x64)", "Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7)", "Mozilla/5.0 (X11; Linux x86_64)", "Mozilla/5.0 (Linux; Android 14)", "curl/8"]
    return spark.createDataFrame([(a,) for a in agents], "agent string").select("agent", urls.agent_family(F.col("agent")).alias("family"))


@query("q_retry_delay", values("attempt, low, high", [(1, 0.5, 1.0), (2, 1.0, 2.0), (3, 2.0, 4.0), (4, 2.5, 5.0), (9, 2.5, 5.0)]))
def q_retry_delay(spark, sf):
    a = F.col("attempt")
    d = lambda x: timing.retry_delay(a, F.lit(1.0), F.lit(5.0), F.lit(x))
    return spark.createDataFrame([(k,) for k in (1, 2, 3, 4, 9)], "attempt int").select("attempt", d(0.0).alias("low"), d(1.0).alias("high"))


@query("q_shaped", values("n, markdown, content, next_offset, truncated, hint", [(1, "# a", None, 3, True, "content truncated at 3 of 8 chars; call read with offset=3 to continue"), (2, None, "plain", None, False, None), (3, None, None, None, False, None)]))
def q_shaped(spark, sf):
    rows = spark.createDataFrame([(1, "# abcdef", "abcdef", 3), (2, None, "plain", 0), (3, None, None, 5)], "n int, md string, c string, cap int")
    s = tx.shaped(F.col("md"), F.col("c"), F.when(F.col("n") == 2, 50).otherwise(F.col("cap")), F.lit(0), tool="read")
    return rows.select("n", s.alias("s")).select("n", "s.markdown", "s.content", "s.next_offset", "s.truncated", "s.hint")


@query("q_invisible_count", "SELECT doc_id, CAST(doc_id % 4 AS INT) AS n FROM documents")
def q_invisible_count(spark, sf):
    from webstrata.sources.tables import table

    t = F.concat(F.repeat(F.lit("​"), (F.col("doc_id") % 4).cast("int")), F.lit("a‍\n"), tx.visible(F.col("text")))
    return table(spark, sf, "documents").select("doc_id", tx.invisible_count(t).alias("n"))


@query("q_messages", "SELECT doc_id, code, severity FROM (SELECT doc_id, unnest(list_filter([CASE WHEN n_chars > 5000 THEN 'long' END, CASE WHEN n_chars < 200 THEN 'short' END, CASE WHEN source IS NULL THEN 'no_source' END], lambda x: x IS NOT NULL)) AS code FROM documents) JOIN (VALUES ('long', 'warning'), ('short', 'info'), ('no_source', 'error')) s(code, severity) USING (code)")
def q_messages(spark, sf):
    from webstrata.sources.tables import table

    n = F.col("n_chars")
    tests = [(n > 5000, "long", "warning", F.lit("long")), (n < 200, "short", "info", F.lit("short")), (F.col("source").isNull(), "no_source", "error", F.lit("none"))]
    return routing.messages(table(spark, sf, "documents"), ["doc_id"], tests).select("doc_id", "code", "severity")


_BLOCKED = [(1, "https://a.example/", None, 403, "<i>px-captcha</i>", "https://a.example/", "Blocked by perimeterx captcha (confidence 0.95)", True), (2, "https://b.example/", "https://b.example/x", 503, "<title>Just a moment...</title>", "https://b.example/x", "Blocked by cloudflare js_challenge (confidence 0.95)", False)]


@query("q_blocked_rows", values("id, final_url, said, solved", [(r[0], r[5], r[6], r[7]) for r in _BLOCKED]))
def q_blocked_rows(spark, sf):
    rows = spark.createDataFrame([(r[0], r[1], r[2], r[3], r[4], r[7]) for r in _BLOCKED], "id int, url string, final string, status int, html string, ok boolean")
    c = detect.mark_resolution(detect.challenge(F.col("html"), F.col("status"), F.lit(None).cast("map<string,string>"), F.col("url")), F.col("ok"))
    b = detect.blocked_row(F.col("url"), F.col("final"), F.col("status"), F.col("html"), c)
    return rows.select("id", b.alias("b")).select("id", "b.final_url", F.regexp_extract("b.error_message", r"^(.*?\))", 1).alias("said"), F.col("b.challenge.resolution_succeeded").alias("solved"))


@query("q_captured", values("n, html, source", [(1, "a", "content"), (2, "b", "evaluate"), (3, "c", "cdp"), (4, None, None)]))
def q_captured(spark, sf):
    rows = spark.createDataFrame([(1, "a", "b", "c"), (2, None, "b", "c"), (3, None, None, "c"), (4, None, None, None)], "n int, a string, b string, c string")
    return rows.select("n", tx.captured(F.col("a"), F.col("b"), F.col("c")).alias("s")).select("n", "s.html", "s.source")


@query("q_skills_run", values("id, domain, accession, tag, error", [(1, "sec.gov", "0000320193-24-000123", None, None), (2, "github.com", None, "v1.2", None), (3, None, None, None, "no_skill"), (4, None, None, None, "no_skill")]))
def q_skills_run(spark, sf):
    calls = [(1, "https://www.sec.gov/Archives/0000320193-24-000123/x", "accession"), (2, "https://github.com/o/r/releases/tag/v1.2", "release"), (3, "https://github.com/o/r", "accession"), (4, "https://other.example/", "release")]
    rows = spark.createDataFrame(calls, "id int, url string, skill string").withColumn("inputs", F.create_map().cast("map<string,string>"))
    out = routing.run_skills(rows, "id")
    return out.select("id", "domain", F.col("output")["accession"].alias("accession"), F.col("output")["tag"].alias("tag"), "error")


@query("q_zip_positions", "SELECT query, position, coalesce(status, 'network_error') AS status FROM (VALUES ('a', 1), ('a', 2), ('b', 1)) t(query, position) LEFT JOIN (VALUES ('a', 2, 'success'), ('b', 1, 'blocked')) f(query, position, status) USING (query, position)")
def q_zip_positions(spark, sf):
    t = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "query string, position int")
    f = spark.createDataFrame([("a", 2, "success"), ("b", 1, "blocked")], "query string, position int, status string")
    return routing.zipped(t, f, "query", "position", {"status": "network_error"})


@query("q_page_weight", "SELECT user_id, sum(event_id) AS total_bytes, min_by(event_id % 97, event_id) FILTER (event_type = 'view') AS ttfb_ms FROM events GROUP BY 1")
def q_page_weight(spark, sf):
    from webstrata.sources.tables import events

    kind = F.when(F.col("event_type") == "view", "document").otherwise("xhr")
    e = events(spark, sf).select("user_id", F.col("event_id").alias("pos"), kind.alias("resource_type"), F.col("event_id").alias("bytes"), (F.col("event_id") % 97).alias("ttfb_ms"))
    return metrics.page_weight(e, "user_id")


@query("q_crawl_summary", "SELECT source, count(*) AS pages, max(doc_id % 4) AS max_depth, sum(n_chars) AS chars, count(*) FILTER (doc_id % 5 = 1) AS failed, count(*) FILTER (doc_id % 5 = 2) AS disallowed, count(DISTINCT doc_id) + count(DISTINCT CASE WHEN doc_id % 3 > 0 THEN -doc_id END) AS discovered, count(*) FILTER (doc_id % 3 = 0) AS offsite FROM documents GROUP BY 1")
def q_crawl_summary(spark, sf):
    from webstrata.sources.tables import table

    d = table(spark, sf, "documents").withColumn("source", F.coalesce("source", F.lit("none")))
    status = F.when(F.col("doc_id") % 5 == 1, "timeout").when(F.col("doc_id") % 5 == 2, "blocked").otherwise("success")
    pages = d.select("source", F.col("doc_id").cast("string").alias("url"), (F.col("doc_id") % 4).alias("depth"), F.col("n_chars").alias("length"), status.alias("status"))
    seen = d.select("source", (-F.col("doc_id")).cast("string").alias("url"), (F.col("doc_id") % 3 == 0).alias("offsite"))
    return metrics.crawl_summary(pages, "source", seen)


_WALK = [("a1", "a2", "h1", "success", 10), ("a2", "a3", "h2", "success", 10), ("a3", "a4", "h1", "success", 10), ("b1", "b2", "h5", "success", 10), ("b2", None, "h6", "blocked", 5), ("c1", "c2", "h7", "success", 0), ("c2", None, "h8", "success", 9), ("d1", "d2", "h9", "success", 90), ("d2", "d3", "h0", "success", 30), ("d3", None, "hx", "success", 1), ("e1", "e1", "hy", "success", 3)]


def _collected(spark, strategy):
    pages = spark.createDataFrame(_WALK, "url string, next_url string, hash string, status string, chars int")
    start = spark.createDataFrame([(w, f"{w}1") for w in "abcdef"], "walk string, url string")
    return walks.collect_pages(pages, start, max_pages=4, strategy=strategy, max_chars=100)


@query("q_collect_stops", values("walk, pages, chars, stopped_reason", [("a", 2, 20, "cycle"), ("b", 1, 10, "blocked"), ("c", 2, 9, "no_next"), ("d", 2, 120, "budget"), ("e", 1, 3, "cycle"), ("f", 0, 0, "error")]))
def q_collect_stops(spark, sf):
    return metrics.collection_summary(_collected(spark, "next_link").withColumn("rank", F.lit(0)), "walk").select("walk", "pages", "chars", "stopped_reason")


@query("q_collect_numbered", values("walk, pages, chars, stopped_reason", [("a", 2, 20, "empty_page"), ("b", 1, 10, "blocked"), ("c", 0, 0, "empty_page"), ("d", 2, 120, "budget"), ("e", 1, 3, "cycle"), ("f", 0, 0, "error")]))
def q_collect_numbered(spark, sf):
    return metrics.collection_summary(_collected(spark, "page_param").withColumn("rank", F.lit(0)), "walk").select("walk", "pages", "chars", "stopped_reason")


@query("q_crawl_budget", values("url, depth, rank, stop", [("a", 0, 1, "budget"), ("b", 1, 2, "budget"), ("c", 1, 3, "budget")]))
def q_crawl_budget(spark, sf):
    links = spark.createDataFrame([("a", "b", 0), ("a", "c", 1), ("a", "d", 2), ("b", "e", 0)], "src string, dst string, pos int")
    seconds = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 5.0)], "url string, seconds double")
    seen, why = walks.crawl(links, spark.createDataFrame([("a",)], "url string"), seconds=seconds, time_budget=8.0)
    return seen.select("url", "depth", "rank", F.lit(why).alias("stop"))


@query("q_remaining_pages", "SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) WHERE r <= 2 + conv_id % 3 AND conv_id % 5 > 0")
def q_remaining_pages(spark, sf):
    from webstrata.sources.tables import table

    c = table(spark, sf, "conversations").select("conv_id", "turn", (F.col("conv_id") % 3 + 2).alias("pages_left"), (F.col("conv_id") % 5).alias("chars_left"))
    return ranking.remaining_pages(c, ["conv_id"], "turn", "pages_left", "chars_left").select("conv_id", "turn")
