"""Detectors for prompt injection and for bot challenges, as Column expressions.

Both read a text once per pattern inside generated code; no pattern is applied in
Python. Null text counts as empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns that override instructions, with their weights.
STRONG = [
    ("ignore_previous", r"\bignore\s+(?:all\s+|the\s+)?(?:previous|prior|above|earlier)\s+(?:instructions?|prompts?|context|messages?|rules?)", 3.0),
    ("disregard_above", r"\bdisregard\s+(?:the\s+|all\s+)?(?:above|previous|prior|earlier|foregoing)", 3.0),
    ("forget_instructions", r"\bforget\s+(?:everything|all|your\s+(?:instructions?|rules?|prompt))", 3.0),
    ("you_are_now", r"\byou\s+are\s+now\s+(?:a|an|the|going\s+to|no\s+longer|in)\b", 3.0),
    ("new_instructions", r"\bnew\s+(?:instructions?|system\s+prompt|rules?|directives?)\s*:", 3.0),
    ("do_not_tell_user", r"\bdo\s+not\s+(?:tell|inform|mention\s+(?:this|it|anything)?\s*to|reveal\s+to|notify)\s+(?:the\s+)?(?:user|human|operator)", 3.0),
    ("reveal_prompt", r"\b(?:reveal|print|repeat|output|show|expose|leak)\s+(?:me\s+)?(?:your|the)\s+(?:full\s+|entire\s+|exact\s+)?(?:system\s+)?(?:prompt|instructions?)", 3.0),
    ("exfiltrate", r"\bexfiltrat(?:e|ing|ion)\b", 3.0),
    ("send_to_url", r"\bsend\s+(?:it|them|the\s+\w+|all\s+\w+)?\s*to\s+https?://", 3.0),
    ("tool_call_injection", r"(?:<tool_call|function_call\s*[:(]|\bcall\s+the\s+[\w.\-]+\s+(?:tool|function)\b)", 3.0),
    ("system_tag", r"</?\s*system\s*>", 2.5),
]
# Patterns that are only suspicious, with their weights.
WEAK = [
    ("system_prompt_phrase", r"\bsystem\s+prompt\b", 1.0),
    ("api_key", r"\bapi[_\s\-]?key\b", 1.0),
    ("credentials", r"\b(?:secret|password|credential|access[_\s\-]?token|private[_\s\-]?key)\b", 0.5),
    ("assistant_directive", r"\b(?:as\s+an?\s+ai|you\s+must|you\s+should\s+now|from\s+now\s+on)\b", 0.5),
]
# Further patterns of the injection rules.
IMPERATIVE = r"\byou\s+(?:must|should|need\s+to|are\s+(?:required|instructed)\s+to|will|have\s+to)\b"
FRAMING = r"(?:^|\n)\s*(?:system|assistant|developer)\s*:|</?\s*(?:system|assistant|developer|inst)\s*>|(?:^|\n)\s*</\s*s\s*>|<\|\s*(?:im_(?:start|end)|start|end)_?(?:of_turn)?\s*\|>|\[/?\s*INST\s*\]"
BLOB = r"[A-Za-z0-9+/]{200,}={0,2}"
MENTION = r"(?:the\s+(?:phrase|string|text|attack|example|instruction|technique|term|word)s?\b|such\s+as\b|like\b|example\s+of\b|known\s+as\b|referred\s+to\s+as\b|called\b|e\.g\.|i\.e\.|patterns?\b|variants?\b|scans?\s+for\b|detect(?:s|ing|ed)?\b|flags?\b|matches?\b|looks?\s+for\b|how\s+to\b|attackers?\s+(?:try|attempt|use|may)\b)"
DISCUSSION = r"\b(?:prompt[\s\-]?injection|jailbreak|attack(?:s|er|ers)?|adversarial|malicious|exploit|vulnerab|security|researchers?|detect(?:or|ion)|mitigat|defen[cs]e|example|technique|payload)\b"
QUOTES_OPEN, QUOTES_CLOSE = "[\"'`“‘]", "[\"'`”’]"

_CI = "(?iu)(?U)"


#: A word that every match of a pattern holds; a plain search for it spares most texts the pattern.
GATES = {
    "ignore_previous": "ignore", "disregard_above": "disregard", "forget_instructions": "forget", "you_are_now": "now", "new_instructions": "new", "do_not_tell_user": "not", "reveal_prompt": "p",
    "exfiltrate": "exfiltrat", "send_to_url": "://", "tool_call_injection": "call", "system_tag": "system", "system_prompt_phrase": "prompt", "api_key": "api", "credentials": "", "assistant_directive": "",
}


def _gated(low: Column, gate: str, test: Column) -> Column:
    return (low.contains(gate) & test) if gate else test


def injection(text: Column) -> Column:
    """struct(score, risk, indicators): how much a text looks like instructions to a model.

    Each strong pattern counts once, at its first match, half if it is quoted or only
    mentioned. At most eight indicators; each is the match with 24 characters about it.
    Whatever is used twice is computed once; a text without a pattern's gate word is
    not searched for the pattern.
    """

    def hit(t: Column, name: str, p: str, w: float) -> Callable[[Column], Column]:
        size = F.length(F.regexp_extract(t, _CI + "(" + p + ")", 1))
        return lambda at: F.struct(F.lit(name).alias("name"), at.alias("at"), F.when(at > 0, size).otherwise(0).alias("n"), F.lit(w).alias("w"))

    def found(t: Column, low: Column, rows: list) -> Column:
        hits = []
        for name, p, w in rows:
            at = F.when(_gated(low, GATES[name], F.lit(True)), F.regexp_instr(t, F.lit(_CI + p))).otherwise(0)
            hits.append(let(at, hit(t, name, p, w)))
        return F.filter(F.array(*hits), lambda s: s["at"] > 0)

    def quoted(t: Column, s: Column) -> Column:
        end, lo, begin = s["at"] + s["n"], F.greatest(F.lit(1), s["at"] - 48), F.greatest(F.lit(1), s["at"] - 2)
        around, left = F.substring(t, lo, end + 16 - lo), F.substring(t, begin, s["at"] - begin)
        return around.rlike(_CI + MENTION) | (left.rlike(QUOTES_OPEN) & F.substring(t, end, F.lit(2)).rlike(QUOTES_CLOSE))

    def judged(t: Column, hits: Column, soft: Column, blob: Column) -> Column:
        bare = F.filter(hits, lambda s: ~s["quoted"])
        some = F.size(hits) > 0
        imperative = some & t.rlike(_CI + IMPERATIVE)
        score = F.aggregate(hits, F.lit(0.0), lambda x, s: x + F.when(s["quoted"], s["w"] * 0.5).otherwise(s["w"])) + F.aggregate(soft, F.lit(0.0), lambda x, s: x + s["w"]) + F.when(blob != "", 3.0).otherwise(0.0)

        def snippet(s: Column) -> Column:
            lo = F.greatest(F.lit(1), s["at"] - 24)
            return F.left(F.trim(F.regexp_replace(F.substring(t, lo, s["at"] + s["n"] + 24 - lo), r"\s+", " ")), F.lit(80))

        plain = lambda a: F.transform(a, lambda s: F.struct(s["at"].alias("at"), s["n"].alias("n")))
        shown = F.concat(F.transform(F.concat(plain(hits), plain(soft)), snippet), F.when(blob != "", F.array(F.concat(F.lit("base64-like blob ("), F.length(blob).cast("string"), F.lit(" chars)")))).otherwise(F.array().cast("array<string>")))

        def decide(imperative: Column, score: Column) -> Column:
            n = F.size(bare)
            leak = F.exists(bare, lambda s: s["name"].isin("send_to_url", "exfiltrate"))
            talk = t.rlike(_CI + DISCUSSION)
            high = (score >= 3.0) & (((n >= 1) & (imperative | t.rlike("(?i)" + FRAMING) | (leak & ~talk))) | ((n >= 3) & ~talk))
            risk = F.when((n >= 1) & high, "high").when((n >= 1) | (score >= 3.0), "medium").when(score >= 1.0, "low").otherwise("none")
            return F.struct(F.round(score, 3).alias("score"), risk.alias("risk"), F.slice(shown, 1, 8).alias("indicators"))

        return let(imperative, lambda i: let(score + F.when(i, 2.0).otherwise(0.0), lambda x: decide(i, x)))

    def search(t: Column, low: Column) -> Column:
        strong = F.transform(found(t, low, STRONG), lambda s: F.struct(s["name"].alias("name"), s["at"].alias("at"), s["n"].alias("n"), s["w"].alias("w"), quoted(t, s).alias("quoted")))
        return let(strong, lambda hits: let(found(t, low, WEAK), lambda soft: let(F.regexp_extract(t, BLOB, 0), lambda blob: judged(t, hits, soft, blob))))

    t = F.coalesce(text, F.lit(""))
    # upper, then lower case: folds the letters that match across cases
    return let(F.lower(F.upper(t)), lambda low: search(t, low))


RISKS = ["none", "low", "medium", "high"]


def risk_rank(risk: Column) -> Column:
    """0 to 3; -1 for a null or unknown risk."""
    return F.coalesce(F.array_position(F.array(*[F.lit(r) for r in RISKS]), risk), F.lit(0)).cast("int") - 1


def contain(content: Column, redacted: Column, risk: Column, action: str) -> tuple[Column, Column]:
    """(content, failure stage) after flag, redact or block; only a high risk is acted on."""
    if action not in ("flag", "redact", "block"):
        raise ValueError(f"unknown action {action!r}")
    if action == "flag":
        return content, F.lit(None).cast("string")
    if action == "redact":
        return F.when(risk == "high", redacted).otherwise(content), F.lit(None).cast("string")
    return F.when(risk == "high", F.lit("")).otherwise(content), F.when(risk == "high", F.lit("injection_blocked"))


# What marks a challenge page of each vendor.
CF_STRONG = ["cf-chl-", "/cdn-cgi/challenge-platform/", "window._cf_chl_opt", "<title>just a moment"]
CF_WEAK = ["cf-turnstile", "challenges.cloudflare.com"]
CF_BLOCK = ["you have been blocked", "<title>attention required"]
CF_SUPPORT = ["cf-error-details", "cf-wrapper", "cloudflare ray id", "cf-ray"]
CF_HEADER = "header:cf-mitigated=challenge"
VENDORS = [
    ("datadome", "captcha", ["geo.captcha-delivery.com", "captcha-delivery.com", "ddjskey"]),
    ("akamai", "js_challenge", ["/_sec/cp_challenge/", "ak-challenge", "sec-cpt-"]),
    ("perimeterx", "captcha", ["px-captcha", "_pxappid", "captcha.px-cdn.net"]),
]
CAPTCHA_SCRIPTS = ["hcaptcha.com/1/api.js", "google.com/recaptcha/api.js", "recaptcha.net/recaptcha/api.js", "google.com/recaptcha/enterprise.js"]
DENIAL_TITLES = ["access denied", "attention required", "verifying you are human", "bot detection", "just a moment", "security check", "are you a robot", "pardon our interruption", "access to this page has been denied"]
DENIAL_STATUS = [403, 429, 503]
SCANNED = 204_800
ACT_AT = 0.7


def _longest(markers: Column) -> Column:
    return F.filter(markers, lambda m: ~F.exists(markers, lambda o: (o != m) & F.contains(o, m)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def title_of(html: Column) -> Column:
    """The title of a page, as written."""
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>\s*([^<]{0,300})", 1))


def visible_text(html: Column) -> Column:
    """An estimate of the visible text: no scripts, styles or tags, white space collapsed."""
    t = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"<[^>]+>", " "), r"\s+", " "))


def page_shape(html: Column) -> Column:
    """struct(title, text_chars, html_chars, tiny_text, low_ratio)."""
    n, text = F.length(F.coalesce(html, F.lit(""))), F.length(visible_text(html))
    return F.struct(
        title_of(html).alias("title"), text.alias("text_chars"), n.alias("html_chars"), (text < 800).alias("tiny_text"), ((n > 20_000) & (text / n < 0.02)).alias("low_ratio")
    )


def challenge(html: Column, status: Column, headers: Column, url: Column) -> Column:
    """struct(vendor, kind, confidence, evidence, auto_settle_likely), or null: is this page a bot challenge?"""
    low = F.lower(F.left(F.coalesce(html, F.lit("")), F.lit(SCANNED)))
    title = lambda x: F.trim(F.regexp_extract(x, r"<title[^>]*>\s*([^<]{0,300})", 1))
    denial = lambda x: let(title(x), lambda s: F.filter(_lits(DENIAL_TITLES), lambda d: s.contains(d)))
    shaped = lambda x, d: let(F.length(visible_text(x)), lambda n: (F.size(d) > 0) | (n < 800) | ((F.length(x) > 20_000) & (n / F.length(x) < 0.02)))
    return let(low, lambda x: let(denial(x), lambda d: let(shaped(x, d), lambda s: _challenge(x, s, d, status, headers, F.lower(F.coalesce(url, F.lit("")))))))


def _lits(xs: list[str]) -> Column:
    return F.array(*[F.lit(x) for x in xs])


def _challenge(low: Column, shaped: Column, denial: Column, status: Column, headers: Column, low_url: Column) -> Column:
    lit = _lits
    denied = F.coalesce(status.isin(DENIAL_STATUS), F.lit(False))
    here = lambda xs, with_url=True: F.filter(lit(xs), lambda m: low.contains(m) | (low_url.contains(m) if with_url else F.lit(False)))
    header = F.exists(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))), lambda e: (F.lower(e["key"]) == "cf-mitigated") & (F.lower(e["value"]) == "challenge"))

    def confidence(strong: Column, weak: Column) -> Column:
        two = lambda x: F.when(strong + weak >= 2, x).otherwise(0.0)
        c = (
            F.when(strong > 0, F.lit(0.85) + F.when(denied, 0.10).otherwise(0.0) + two(0.03))
            .when(denied, F.lit(0.85) + two(0.05))
            .when(shaped, F.lit(0.75) + two(0.05))
            .otherwise(F.lit(0.50) + two(0.10))
        )
        return F.round(F.least(c, F.lit(0.98)), 2)

    def candidate(vendor: Column, kind: Column, conf: Column, evidence: Column, strong: Column, order: int) -> Column:
        some = F.slice(evidence, 1, 5)
        return F.struct(conf.alias("confidence"), strong.alias("strong"), F.size(some).alias("n"), F.lit(-order).alias("order"), vendor.alias("vendor"), kind.alias("kind"), some.alias("evidence"))

    none = F.array().cast("array<string>")

    def cloudflare(strong: Column, weak: Column, block: Column, support: Column) -> Column:
        v = F.lit("cloudflare")
        return (
            F.when(F.size(strong) > 0, candidate(v, F.lit("js_challenge"), confidence(F.size(strong), F.size(weak)), F.concat(strong, weak), F.size(strong), 0))
            .when((F.size(block) > 0) & (F.size(support) > 0), candidate(v, F.lit("block_page"), confidence(F.size(block), F.size(support)), F.concat(block, support), F.size(block), 0))
            .when(F.size(weak) > 0, candidate(v, F.lit("captcha"), confidence(F.lit(0), F.size(weak)), weak, F.lit(0), 0))
        )

    strong = F.concat(here(CF_STRONG), F.when(header, lit([CF_HEADER])).otherwise(none))
    cf = let(strong, lambda s: let(here(CF_WEAK), lambda w: let(here(CF_BLOCK, False), lambda b: let(here(CF_SUPPORT, False), lambda u: cloudflare(s, w, b, u)))))
    found = [cf]
    for k, (vendor, kind, markers) in enumerate(VENDORS):
        found.append(let(_longest(here(markers)), _simple(vendor, kind, k + 1, candidate, confidence)))
    scripts = here(CAPTCHA_SCRIPTS, False)
    found.append(let(scripts, lambda x: F.when((F.size(x) > 0) & (denied | (F.size(denial) > 0)), candidate(F.lit("generic"), F.lit("captcha"), F.when(denied, 0.9).otherwise(0.75), x, F.lit(0), 9))))
    info = lambda v, k, c, e, a: F.struct(v.alias("vendor"), k.alias("kind"), c.alias("confidence"), e.alias("evidence"), a.alias("auto_settle_likely"))

    def chosen(best: Column) -> Column:
        kind = F.when(status == 429, F.lit("rate_limit")).otherwise(best["kind"])
        return F.when(best.isNotNull(), info(best["vendor"], kind, best["confidence"], best["evidence"], (best["vendor"] == "cloudflare") & (kind == "js_challenge"))).when(
            denied & shaped & (F.size(denial) > 0),
            info(F.lit("unknown"), F.lit("block_page"), F.lit(0.55), F.array(F.concat(F.lit("denial_title:"), denial[0]), F.concat(F.lit("status:"), status.cast("string"))), F.lit(False)),
        )

    # nulls, vendors that were not found, don't count for the maximum
    return let(F.array_max(F.array(*found)), chosen)


def _simple(vendor: str, kind: str, order: int, candidate, confidence) -> Callable[[Column], Column]:
    return lambda hit: F.when(F.size(hit) > 0, candidate(F.lit(vendor), F.lit(kind), confidence(F.size(hit), F.lit(0)), hit, F.size(hit), order))


# Signs that a search engine or a browser refuses, in errors, addresses and markup.
RATE_MARKS = ["ratelimit", "rate limit", "202 ratelimit"]
RACE_MARKS = ["navigating and changing", "page is navigating"]
ANOMALY_MARKS = ["anomaly in your", "unfortunately, bots", "if this error persists"]
CAPTCHA_MARKUP = r"(?is)<form\b[^>]*\bid\s*=\s*[\"']?captcha-form\b|<div\b[^>]*\bid\s*=\s*[\"']?recaptcha\b|<iframe\b[^>]*\bsrc\s*=\s*[\"']?[^\"'>]*recaptcha"
ANOMALY_MARKUP = r"(?is)<form\b[^>]*\bid\s*=\s*[\"']?challenge-form\b|<input\b[^>]*\bname\s*=\s*[\"']?anomaly_token\b"


def _any_of(text: Column, marks: list[str]) -> Column:
    return F.exists(_lits(marks), lambda m: text.contains(m))


def rate_limited(error: Column, message: Column) -> Column:
    """Whether an error, by its class or its message, says that a provider limits or blocks."""
    name = F.lower(F.coalesce(error, F.lit("")))
    return (name.contains("rate") & name.contains("limit")) | _any_of(F.lower(F.coalesce(message, F.lit(""))), RATE_MARKS)


def navigation_race(message: Column) -> Column:
    """Whether an error says that the page was still changing."""
    return _any_of(F.coalesce(message, F.lit("")), RACE_MARKS)


def search_refused(url: Column, html: Column, engine: Column) -> Column:
    """Whether a result page is a wall of its engine instead: `google` shows a captcha, `duckduckgo` an anomaly page."""
    u, h = F.lower(F.coalesce(url, F.lit(""))), F.coalesce(html, F.lit(""))
    captcha = u.contains("/sorry/") | u.contains("captcha") | h.rlike(CAPTCHA_MARKUP)
    anomaly = u.contains("anomaly") | u.contains("/sorry") | h.rlike(ANOMALY_MARKUP) | _any_of(F.lower(F.left(visible_text(h), F.lit(600))), ANOMALY_MARKS)
    return F.when(engine == "google", captcha).when(engine == "duckduckgo", anomaly).otherwise(False)


def blocked_row(url: Column, final_url: Column, status: Column, html: Column, found: Column) -> Column:
    """struct of a read that a standing wall stopped: the wall's page, what it is, and what can be done."""
    said = F.concat(
        F.lit("Blocked by "), found["vendor"], F.lit(" "), found["kind"], F.lit(" (confidence "), F.format_string("%.2f", found["confidence"]), F.lit("). Do not retry at once: wait a minute or more, use a signed-in profile, ask a person, or read another source."),
    )
    whole = F.coalesce(F.nullif(final_url, F.lit("")), url)
    return F.struct(url.alias("url"), whole.alias("final_url"), status.alias("status_code"), F.lit("blocked").alias("status"), F.nullif(html, F.lit("")).alias("html"), found.alias("challenge"), said.alias("error_message"))


def mark_resolution(found: Column, succeeded: Column) -> Column:
    """The challenge with what became of an attempt to resolve it."""
    return found.withField("resolution_attempted", F.lit(True)).withField("resolution_succeeded", succeeded)
