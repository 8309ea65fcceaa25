"""Text and value expressions (built-in functions only). Null in, null out, unless told otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as white space at a line's end.
_BLANK = r"[ \t\f\x0b\x1c-\x1f\x85\xa0  ]"
# A number with or without thousands separators.
NUMBER = r"^[+-]?\d{1,3}(?:,\d{3})+(?:\.\d+)?$|^[+-]?\d+(?:\.\d+)?$"
# Parts of a key's name that make its value secret.
SECRET = r"(?i)password|passwd|token|secret|key|credential|authorization|auth|cookie|session|bearer|api_key|apikey|access|private"
REDACTED = "***REDACTED***"
# Invisible characters, except line ends, tab and joiners.
INVISIBLE = r"[\p{Cf}&&[^‌‍]]|[\x{E0000}-\x{E007F}]"


def normalize(text: Column) -> Column:
    """Line ends to LF, no blanks at line ends, three or more blank lines to one, no blank lines at the edges."""
    t = F.regexp_replace(text, "\r\n|\r", "\n")
    t = F.regexp_replace(t, _BLANK + r"+(?=\n|\z)", "")
    t = F.regexp_replace(t, r"\n{4,}", "\n\n")
    return F.regexp_replace(t, r"\A\n+|\n+\z", "")


def content_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def visible(text: Column) -> Column:
    """Without invisible characters."""
    return F.regexp_replace(text, INVISIBLE, "")


def window(text: Column, offset: Column, most: Column, snap: int = 200) -> tuple[Column, Column]:
    """(slice, next offset or null). A cut inside the text moves back to a line end among the last `snap` characters."""
    n = F.length(text)
    begin = F.greatest(F.lit(0), F.least(offset, n))
    end = F.least(begin + F.greatest(F.lit(1), most), n)
    tail_from = F.greatest(begin, end - snap)
    tail = F.substring(text, tail_from + 1, end - tail_from)
    back = F.locate("\n", F.reverse(tail))
    cut = F.when((end < n) & (back > 0) & (end - back + 1 > begin), end - back + 1).otherwise(end)
    return F.substring(text, begin + 1, cut - begin), F.when(cut < n, cut)


def capped(text: Column, most: int) -> tuple[Column, Column]:
    """(text cut to `most` characters, whether it was cut)."""
    return F.left(text, F.lit(most)), F.length(text) > most


def failure_message(status: Column, code: Column) -> Column:
    """What to say of a failed read: by the response code first, then by the status."""
    return (
        F.when(code == 404, "page not found (HTTP 404)")
        .when(code.isin(401, 403), F.concat(F.lit("access denied (HTTP "), code.cast("string"), F.lit(")")))
        .when(code == 429, "rate limited (HTTP 429)")
        .when(code >= 500, F.concat(F.lit("server error (HTTP "), code.cast("string"), F.lit(")")))
        .when(code >= 400, F.concat(F.lit("client error (HTTP "), code.cast("string"), F.lit(")")))
        .when(status == "timeout", "timed out")
        .when(status == "blocked", "blocked by policy")
        .otherwise(F.concat(F.lit("fetch failed: "), F.coalesce(status, F.lit("unknown"))))
    )


def normalize_name(name: Column) -> Column:
    """Lower case, runs of `_`, `-`, `.` and white space to one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), r"[_\-.]+", " "), r"\s+", " "))


def name_tokens(normal: Column) -> Column:
    return F.array_distinct(F.filter(F.split(normal, " "), lambda x: x != ""))


def coerce(value: Column, most: int = 4000) -> tuple[Column, Column]:
    """(text, number): a bare quantity has a number too; phone-like, zero-led and very long digits stay text."""
    t = F.trim(value)
    clean = F.replace(t, F.lit(","), F.lit(""))
    body = F.regexp_replace(clean, r"^[+-]", "")
    plain = t.rlike(NUMBER) & ~t.startswith("+") & ~(~body.contains(".") & (F.length(body) > 1) & body.startswith("0")) & (F.length(F.replace(body, F.lit("."), F.lit(""))) <= 15)
    return F.left(t, F.lit(most)), F.when(plain, clean.try_cast("double"))


def rank_tokens(text: Column) -> Column:
    """Distinct runs of letters and digits of two characters or more, in lower case."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([a-z0-9]+)"), 1), lambda x: F.length(x) >= 2))


def redact_map(m: Column) -> Column:
    return F.transform_values(m, lambda k, v: F.when(k.rlike(SECRET), F.lit(REDACTED)).otherwise(v))


def lower_headers(m: Column) -> Column:
    """Keys and values in lower case; of keys that become equal the first stays."""
    pairs = F.map_entries(m)
    low = F.transform(pairs, lambda p: F.struct(F.lower(p["key"]).alias("key"), F.lower(p["value"]).alias("value")))
    first = F.aggregate(low, F.array().cast("array<struct<key:string,value:string>>"), lambda acc, p: F.when(F.exists(acc, lambda q: q["key"] == p["key"]), acc).otherwise(F.concat(acc, F.array(p))))
    return F.map_from_entries(first)


def retry_after(header: Column, now: Column) -> Column:
    """Seconds to wait: a whole number, or an HTTP date against `now`; never below 0; else null."""
    h = F.trim(header)
    at = F.try_to_timestamp(F.substring(h, 6, 20), F.lit("dd MMM yyyy HH:mm:ss"))
    return F.coalesce(F.when(h.rlike(r"^\d+$"), h.try_cast("double")), F.when(at.isNotNull(), F.greatest(F.lit(0.0), F.unix_timestamp(at).cast("double") - F.unix_timestamp(now).cast("double"))))


def query_term(text: Column) -> Column:
    """A search term without operators, quotes or repeated space."""
    t = F.regexp_replace(text, r"[\"'`]", " ")
    t = F.regexp_replace(t, r"(?i)\b(?:site|inurl|intitle|filetype|ext):", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[()|]", " "), r"\s+", " "))


def snapshot_label(label: Column) -> Column:
    """A label that is a safe file name: at most 120 characters, null if nothing is left."""
    t = F.regexp_replace(F.trim(label), r"[^A-Za-z0-9._-]", "_")
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "_+", "_"), r"^\.+", ""), "^_+|_+$", "")
    return F.nullif(F.regexp_replace(F.left(t, F.lit(120)), "^_+|_+$", ""), F.lit(""))


def fenced(text: Column, source: Column, nonce: Column) -> Column:
    """Text of a foreign page between markers that it cannot forge, as the nonce is taken out of it."""
    begin = F.concat(F.lit("<<<UNTRUSTED "), nonce, F.lit(" source="), F.coalesce(source, F.lit("unknown")), F.lit(">>>\n"))
    return F.concat(begin, F.replace(text, nonce, F.lit("")), F.lit("\n<<<END "), nonce, F.lit(">>>"))


def markdown_table(rows: Column) -> Column:
    """array<array<string>> as a table: bars escaped, line ends to spaces, short rows filled; null if empty."""
    width = F.array_max(F.transform(rows, lambda r: F.size(r)))
    cell = lambda c: F.trim(F.regexp_replace(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|")), r"\r\n|\r|\n", " "))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.concat(F.transform(r, cell), F.array_repeat(F.lit(""), width - F.size(r))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    return F.when(F.size(rows) > 0, F.concat_ws("\n", line(rows[0]), rule, F.transform(F.slice(rows, F.lit(2), F.size(rows)), line)))


def decode_body(body: Column, cap: int) -> tuple[Column, Column]:
    """(first `cap` bytes as text, bad bytes replaced; whether more were there)."""
    return F.make_valid_utf8(F.substring(body, 1, cap).cast("string")), F.octet_length(body) > cap


def clamp(n: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(n, F.lit(high)))


def invisible_count(text: Column) -> Column:
    """How many characters :func:`visible` takes out."""
    return F.length(text) - F.length(visible(text))


def shaped(markdown: Column, content: Column, cap: Column, offset: Column, form: str | None = None, tool: str = "this tool") -> Column:
    """struct(markdown, content, total_chars, offset, next_offset, truncated, hint): one form of a page, a window of it.

    Markdown is preferred unless `form` is text; what isn't shown is null. `cap` is
    held between 1 and a million.
    """
    md = F.lit(None).cast("string") if form == "text" else markdown
    whole = F.coalesce(md, content)
    start = F.greatest(F.lit(0), offset)
    piece, follows = window(whole, start, clamp(cap, 1, 1_000_000))
    # Fixed value: the wording of the hint.
    hint = F.concat(F.lit("content truncated at "), follows.cast("string"), F.lit(" of "), F.length(whole).cast("string"), F.lit(f" chars; call {tool} with offset="), follows.cast("string"), F.lit(" to continue"))
    return F.struct(
        F.when(md.isNotNull(), piece).alias("markdown"), F.when(md.isNull(), piece).alias("content"), F.length(whole).alias("total_chars"), start.alias("offset"),
        follows.alias("next_offset"), F.coalesce(follows.isNotNull(), F.lit(False)).alias("truncated"), hint.alias("hint"),
    )


def captured(content: Column, evaluated: Column, snapshot: Column) -> Column:
    """struct(html, source): the first of three captures of a page that isn't null."""
    return F.struct(F.coalesce(content, evaluated, snapshot).alias("html"), F.when(content.isNotNull(), "content").when(evaluated.isNotNull(), "evaluate").when(snapshot.isNotNull(), "cdp").alias("source"))


def document_title(title: Column) -> Column:
    """A title from a file's properties; blank ones are none."""
    return F.nullif(F.trim(title), F.lit(""))
