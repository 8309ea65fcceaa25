"""URL parts and kinds as Column expressions (built-in functions only).

Hosts and paths come from two regular expressions that also take URLs which strict
parsers refuse. A null URL gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOST = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)"
PATH = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)"

# Kinds by extension, in the order in which they are tried.
EXTENSION_KIND = {
    ".pdf": "pdf", ".doc": "docx", ".docx": "docx", ".xls": "xlsx", ".xlsx": "xlsx", ".csv": "csv", ".tsv": "csv",
    ".zip": "zip", ".tar": "zip", ".gz": "zip", ".rar": "zip", ".7z": "zip",
}
# Further extensions that are downloads, and those of pages.
DOWNLOAD_ONLY = [".ppt", ".pptx", ".mp3", ".mp4", ".avi", ".mov", ".wav", ".exe", ".msi", ".dmg", ".deb", ".rpm", ".iso", ".img"]
PAGE_EXTENSIONS = [".html", ".htm", ".xhtml", ".aspx", ".asp", ".php", ".jsp", ".cgi", ".shtml", ".phtml"]
# Kinds by the beginning of the content type.
CONTENT_KIND = {
    "application/pdf": "pdf",
    "application/vnd.openxmlformats-officedocument.spreadsheetml": "xlsx",
    "application/vnd.ms-excel": "xlsx",
    "application/vnd.openxmlformats-officedocument.wordprocessingml": "docx",
    "application/msword": "docx",
    "text/csv": "csv",
    "text/tab-separated-values": "csv",
}
BINARY_KINDS = ["pdf", "xlsx", "docx", "csv", "zip", "binary_other"]
EXTRACTABLE_KINDS = ["pdf", "xlsx", "docx", "csv"]
# Content types that are binary though no kind is known.
BINARY_TYPES = ["application/octet-stream", "application/zip", "application/vnd.", "application/x-"]


def host(url: Column) -> Column:
    """Lower-cased host without port, user or brackets; empty if there is none."""
    return F.lower(F.translate(F.regexp_extract(url, HOST, 1), "[]", ""))


def path(url: Column) -> Column:
    """The path, without the parameters of its last segment."""
    return F.regexp_replace(F.regexp_extract(url, PATH, 1), r";[^/]*$", "")


def extension(url: Column) -> Column:
    """Lower-cased suffix of the last path segment with its dot; empty if there is none."""
    return F.lower(F.regexp_extract(path(url), r"[^/](\.[^./]*)$", 1))


def kind_by_extension(url: Column) -> Column:
    """pdf, docx, xlsx, csv, zip, binary_other, html or unknown, from the path alone."""
    p = F.lower(path(url))
    out = F.when(url.isNull(), None)
    for ext, kind in EXTENSION_KIND.items():
        out = out.when(p.endswith(ext), kind)
    for ext in DOWNLOAD_ONLY:
        out = out.when(p.endswith(ext), "binary_other")
    for ext in PAGE_EXTENSIONS:
        out = out.when(p.endswith(ext), "html")
    return out.otherwise("unknown")


def kind_by_headers(content_type: Column, disposition: Column) -> Column:
    """Kind from response headers: the type's prefix, then an attachment, then octets, then html."""
    ct = F.trim(F.lower(F.split_part(F.coalesce(content_type, F.lit("")), F.lit(";"), F.lit(1))))
    out = F.when(F.lit(False), None)
    for prefix, kind in CONTENT_KIND.items():
        out = out.when(ct.startswith(prefix), kind)
    out = out.when(F.lower(F.coalesce(disposition, F.lit(""))).contains("attachment"), "binary_other")
    for prefix in BINARY_TYPES:
        out = out.when(ct.startswith(prefix), "binary_other")
    return out.when(ct.startswith("text/html") | ct.startswith("application/xhtml"), "html").otherwise("unknown")


def is_binary_kind(kind: Column) -> Column:
    return kind.isin(BINARY_KINDS)


def is_extractable_kind(kind: Column) -> Column:
    return kind.isin(EXTRACTABLE_KINDS)


def is_download(url: Column) -> Column:
    return kind_by_extension(url).isin(BINARY_KINDS)


def document_kind(content_type: Column, url: Column) -> Column:
    """pdf, xlsx, docx or csv by content type or path, in this order; else null."""
    ct, p = F.lower(F.coalesce(content_type, F.lit(""))), F.lower(path(url))
    return (
        F.when(ct.contains("application/pdf") | p.endswith(".pdf"), "pdf")
        .when(ct.contains("spreadsheetml") | ct.contains("ms-excel") | p.endswith(".xlsx"), "xlsx")
        .when(ct.contains("wordprocessingml") | p.endswith(".docx"), "docx")
        .when(ct.contains("text/csv") | ct.contains("tab-separated-values") | p.endswith(".csv") | p.endswith(".tsv"), "csv")
    )


def registrable_domain(h: Column) -> Column:
    """The last two labels of a host; shorter hosts unchanged."""
    return F.when(F.size(F.split(h, r"\.")) <= 2, h).otherwise(F.substring_index(h, ".", -2))


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, r"#.*$", "")


def in_scope(h: Column, scope: Column, wide: bool) -> Column:
    """Same host, or same registrable domain if wide; an empty host never."""
    return (h != "") & ((registrable_domain(h) == registrable_domain(scope)) if wide else (h == scope))


def resolve(base: Column, href: Column) -> Column:
    """The absolute form of a reference, for absolute, host-relative, root-relative, query and sibling references.

    Dot segments stay; :func:`webstrata.functions.html.join_url` resolves these.
    """
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    bare = F.regexp_replace(base, r"[?#].*$", "")
    folder = F.when(bare == origin, F.concat(origin, F.lit("/"))).otherwise(F.regexp_replace(bare, r"[^/]*$", ""))
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("/"), F.concat(origin, href))
        .when(href.startswith("?"), F.concat(bare, href))
        .otherwise(F.concat(folder, href))
    )


def bump_page(url: Column) -> Column:
    """The URL with its first numeric `page` or `p` parameter one higher; null if there is none."""
    q = r"^([^?#]*\?(?:[^#]*?&)?(?i:page|p)=)([0-9]+)((?:&[^#]*)?(?:#.*)?)$"
    n = F.regexp_extract(url, q, 2)
    return F.when(n != "", F.concat(F.regexp_extract(url, q, 1), (F.try_to_number(n, F.lit("9" * 18)) + 1).cast("bigint").cast("string"), F.regexp_extract(url, q, 3)))


def query_param(url: Column, name: str) -> Column:
    return F.try_url_decode(F.regexp_extract(url, rf"[?&]{name}=([^&#]*)", 1))


def unwrap_redirect(href: Column) -> Column:
    """The target of a search engine's redirect link, else the link itself."""
    target = query_param(href, "uddg")
    return F.when(href.contains("uddg=") & (target != ""), target).otherwise(href)


def is_url_query(query: Column) -> Column:
    q = F.lower(F.trim(query))
    return (q.startswith("http://") | q.startswith("https://")) & ~F.trim(query).rlike(r"\s")


def unwrap_search_url(url: Column) -> Column:
    """The query inside a result-page URL, at most 1024 characters; else the URL."""
    q = F.coalesce(F.nullif(query_param(url, "q"), F.lit("")), F.nullif(query_param(url, "query"), F.lit("")))
    return F.when(path(url).rlike(r"/search/?$") & q.isNotNull(), F.left(q, F.lit(1024))).otherwise(url)


def key_hint(key: Column) -> Column:
    """What may be logged of a cache key: no query, no user, 200 characters."""
    return F.left(F.regexp_replace(F.split_part(key, F.lit("?"), F.lit(1)), r"://[^/@\s]*@", "://"), F.lit(200))


def under_domain(h: Column, domain: str) -> Column:
    return (h == domain) | h.endswith("." + domain)


def is_private_literal(h: Column) -> Column:
    """Loopback, private, link-local and unspecified IPv4 literals, local names, IPv6 loopback and local ranges."""
    quad = r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$"
    a, b = F.regexp_extract(h, quad, 1).try_cast("int"), F.regexp_extract(h, quad, 2).try_cast("int")
    v4 = h.rlike(quad) & ((a == 10) | (a == 127) | (a == 0) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254)) | ((a == 100) & b.between(64, 127)) | (a >= 224))
    names = (h == "localhost") | h.endswith(".localhost") | h.endswith(".local") | h.endswith(".internal")
    return v4 | names | h.isin("::1", "::") | h.rlike(r"^f[cd][0-9a-f]{2}:") | h.rlike(r"^fe[89ab][0-9a-f]:")


def gate(url: Column, *, deny: list[str] | None = None, allow: list[str] | None = None) -> Column:
    """Whether a URL may be read: it has a public host, no denied domain, and an allowed one if any are named."""
    return gate_host(host(url), deny=deny, allow=allow)


def gate_host(h: Column, *, deny: list[str] | None = None, allow: list[str] | None = None) -> Column:
    """The same for a host; where it is a column of its own it is computed once."""
    ok = (h != "") & ~is_private_literal(h)
    for d in deny or []:
        ok = ok & ~under_domain(h, d.lower())
    if allow:
        any_ = F.lit(False)
        for d in allow:
            any_ = any_ | under_domain(h, d.lower())
        ok = ok & any_
    return F.coalesce(ok, F.lit(False))


def agent_family(text: Column) -> Column:
    """Desktop family named in a user agent: windows, macos or linux; else null."""
    t = F.lower(text)
    return (
        F.when(t.contains("windows") | t.contains("win64") | t.contains("win32"), "windows")
        .when(t.contains("macintosh") | t.contains("mac os x"), "macos")
        .when(t.contains("linux") | t.contains("x11"), "linux")
    )


def locale_family(locale: Column) -> Column:
    """The family that goes with a locale: one for all, also for none."""
    return F.when(locale.isNull(), "windows").otherwise("windows")


def pick_agent(family: Column, draw: Column, pool: dict[str, list[str]]) -> Column:
    """An agent of the family, by a whole number `draw`; of all families where it has none."""
    everyone = F.array(*[F.lit(a) for agents in pool.values() for a in agents])
    own = everyone
    for name, agents in pool.items():
        own = F.when(F.lower(family) == name, F.array(*[F.lit(a) for a in agents])).otherwise(own)
    return F.get(own, F.pmod(draw, F.size(own)).cast("int"))


def safe_file_name(value: Column) -> Column:
    """Whether a relative path stays inside its folder on any system."""
    return ~(value.rlike(r"^[/\\]") | value.rlike(r"^[A-Za-z]:") | value.rlike(r"(^|[/\\])\.\.([/\\]|$)") | value.rlike(r"(?i)(^|[/\\])(con|prn|aux|nul|com[1-9]|lpt[1-9])(\.[^/\\]*)?$") | value.contains("\x00")) & (F.trim(value) != "")
