"""URL expressions: split, RFC 3986 join, site, section, scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import col, py_capitalize, py_title

# --- fixed values -----------------------------------------------------------
# Schemes for which Python's urllib joins relative references, and schemes
# that carry a network location (urllib.parse.uses_relative / uses_netloc).
USES_RELATIVE = [
    "", "ftp", "http", "gopher", "nntp", "imap", "wais", "file", "https",
    "shttp", "mms", "prospero", "rtsp", "rtsps", "rtspu", "sftp", "svn",
    "svn+ssh", "ws", "wss",
]
USES_NETLOC = [
    "", "ftp", "http", "gopher", "nntp", "telnet", "imap", "wais", "file",
    "mms", "https", "shttp", "snews", "prospero", "rtsp", "rtsps", "rtspu",
    "rsync", "svn", "svn+ssh", "sftp", "nfs", "git", "git+ssh", "ws", "wss",
    "itms-services",
]
SCHEME_PATTERN = r"^([a-zA-Z][a-zA-Z0-9+.\-]*):"
# after the scheme: //netloc, path, ?query, #fragment (RFC 3986 appendix B)
REST_PATTERN = r"(?s)^(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?"
SITE_PATTERN = r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)"
EXCLUDED_SUFFIXES = [".pdf", ".jpg", ".png", ".gif", ".zip"]
HOME_SECTION = "Home"
# ---------------------------------------------------------------------------


def clean_url(c) -> Column:
    """Leading C0 controls and spaces dropped, tab/CR/LF removed anywhere."""
    return F.regexp_replace(F.regexp_replace(col(c), r"^[\x{00}-\x{20}]+", ""), r"[\t\r\n]", "")


def split_url(c, default_scheme: Column | None = None) -> dict[str, Column]:
    """Python ``urlsplit`` as columns; params stay part of the path."""
    s = clean_url(c)
    scheme = F.lower(F.regexp_extract(s, SCHEME_PATTERN, 1))
    rest = F.when(scheme != "", F.substring(s, F.length(scheme) + 2, F.lit(1 << 30))).otherwise(s)
    netloc_mark = F.regexp_extract(rest, REST_PATTERN, 1)
    parts = {
        "scheme": scheme if default_scheme is None else
        F.when(scheme != "", scheme).otherwise(default_scheme),
        "has_netloc": netloc_mark != "",
        "netloc": F.regexp_extract(rest, REST_PATTERN, 2),
        "path": F.regexp_extract(rest, REST_PATTERN, 3),
        "query": F.regexp_extract(rest, REST_PATTERN, 5),
        "fragment": F.regexp_extract(rest, REST_PATTERN, 7),
    }
    return parts


def unsplit_url(scheme, netloc, path, query, fragment) -> Column:
    """Python ``urlunsplit``."""
    in_netloc = scheme.isin(USES_NETLOC)
    body = (
        F.when(netloc != "", F.concat(
            F.lit("//"), netloc,
            F.when((path != "") & ~path.startswith("/"), F.concat(F.lit("/"), path)).otherwise(path)))
        .when(path.startswith("//"), F.concat(F.lit("//"), path))
        .when((scheme != "") & in_netloc & ((path == "") | path.startswith("/")),
              F.concat(F.lit("//"), path))
        .otherwise(path)
    )
    with_scheme = F.when(scheme != "", F.concat(scheme, F.lit(":"), body)).otherwise(body)
    return F.concat(
        with_scheme,
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")),
        F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(F.lit("")),
    )


def _drop_dot_segments(segs: Column) -> Column:
    folded = F.aggregate(
        segs,
        F.array().cast("array<string>"),
        lambda acc, x: F.when(x == "..", F.when(F.size(acc) > 0, F.slice(acc, 1, F.size(acc) - 1))
                              .otherwise(acc))
        .when(x == ".", acc)
        .otherwise(F.concat(acc, F.array(x))),
    )
    tail_dir = F.element_at(segs, -1).isin(".", "..")
    return F.when(tail_dir, F.concat(folded, F.array(F.lit("")))).otherwise(folded)


def _split_stage(df: DataFrame, c: str, p: str, default_scheme: str | None = None) -> DataFrame:
    """Add ``{p}_scheme/_netloc/_path/_query/_frag`` columns for ``urlsplit(c)``."""
    df = df.withColumn(f"{p}_s", clean_url(c))
    s = F.col(f"{p}_s")
    df = df.withColumn(f"{p}_sch0", F.lower(F.regexp_extract(s, SCHEME_PATTERN, 1)))
    sch0 = F.col(f"{p}_sch0")
    df = df.withColumn(f"{p}_rest", F.when(sch0 != "", F.substring(s, F.length(sch0) + 2, F.lit(1 << 30)))
                       .otherwise(s))
    rest = F.col(f"{p}_rest")
    scheme = sch0 if default_scheme is None else F.when(sch0 != "", sch0).otherwise(F.col(default_scheme))
    return df.select(
        "*",
        scheme.alias(f"{p}_scheme"),
        F.regexp_extract(rest, REST_PATTERN, 2).alias(f"{p}_netloc"),
        F.regexp_extract(rest, REST_PATTERN, 3).alias(f"{p}_path"),
        F.regexp_extract(rest, REST_PATTERN, 5).alias(f"{p}_query"),
        F.regexp_extract(rest, REST_PATTERN, 7).alias(f"{p}_frag"),
    )


def with_resolved_url(df: DataFrame, base: str, href: str, out: str, p: str = "_rz") -> DataFrame:
    """Add ``out = urllib.parse.urljoin(base, href)``.

    Computed in stages (one projection per step) so every URL part is
    evaluated once per row; the dot-segment fold only runs for paths that
    need it.
    """
    b, u = f"{p}b", f"{p}u"
    df = _split_stage(df, base, b)
    df = _split_stage(df, href, u, default_scheme=f"{b}_scheme")
    c = F.col
    scheme, upath = c(f"{u}_scheme"), c(f"{u}_path")
    df = df.select(
        "*",
        scheme.isin(USES_NETLOC).alias(f"{p}_innet"),
        F.split(c(f"{b}_path"), "/", -1).alias(f"{p}_bparts"),
        F.split(upath, "/", -1).alias(f"{p}_uparts"),
    )
    bparts = c(f"{p}_bparts")
    bdir = F.when(F.element_at(bparts, -1) != "", F.slice(bparts, 1, F.size(bparts) - 1)).otherwise(bparts)
    df = df.select(
        "*",
        F.when(c(f"{p}_innet"), c(f"{b}_netloc")).otherwise(c(f"{u}_netloc")).alias(f"{p}_netloc"),
        F.concat(bdir, c(f"{p}_uparts")).alias(f"{p}_rel0"),
    )
    rel0 = c(f"{p}_rel0")
    n = F.size(rel0)
    rel = F.when(n > 2, F.concat(F.slice(rel0, 1, 1),
                                 F.filter(F.slice(rel0, 2, n - 2), lambda x: x != ""),
                                 F.slice(rel0, n, 1))).otherwise(rel0)
    plain_abs = upath.startswith("/") & ~upath.rlike(r"(^|/)\.\.?(/|\z)")
    segs = F.when(upath.startswith("/"), c(f"{p}_uparts")).otherwise(rel)
    df = df.withColumn(f"{p}_mpath", F.when(plain_abs, upath).otherwise(
        F.array_join(_drop_dot_segments(segs), "/")))
    mpath = F.when(c(f"{p}_mpath") == "", F.lit("/")).otherwise(c(f"{p}_mpath"))
    netloc, query, frag = c(f"{p}_netloc"), c(f"{u}_query"), c(f"{u}_frag")
    other = (scheme != c(f"{b}_scheme")) | ~scheme.isin(USES_RELATIVE)
    resolved = (
        F.when(c(href) == "", c(base))
        .when(other, c(href))
        .when(c(f"{p}_innet") & (c(f"{u}_netloc") != ""),
              unsplit_url(scheme, c(f"{u}_netloc"), upath, query, frag))
        .when(upath == "", unsplit_url(scheme, netloc, c(f"{b}_path"),
                                       F.when(query != "", query).otherwise(c(f"{b}_query")), frag))
        .otherwise(unsplit_url(scheme, netloc, mpath, query, frag))
    )
    df = df.withColumn(out, resolved)
    return df.drop(*[x for x in df.columns if x.startswith(p)])


def site_of(url) -> Column:
    """``scheme://authority`` of an absolute URL; '' when there is none."""
    return F.regexp_extract(col(url), SITE_PATTERN, 1)


def url_path(url) -> Column:
    """``urlparse(url).path``: the path without ``;params`` of its last segment."""
    return F.regexp_replace(split_url(url)["path"], r";[^/]*\z", "")


def section_key(url) -> Column:
    """P5: first path segment with all outer slashes stripped, or ``Home``."""
    stripped = F.regexp_replace(url_path(url), r"^/+|/+\z", "")
    first = F.substring_index(stripped, "/", 1)
    return F.when(first == "", F.lit(HOME_SECTION)).otherwise(first)


def section_label(slug) -> Column:
    """``-`` and ``_`` to spaces, then Python title case."""
    return py_title(F.translate(col(slug), "-_", "  "))


def site_name(base_url) -> Column:
    """Second-to-last dot part of the host, capitalised; the host if no dot."""
    netloc = split_url(base_url)["netloc"]
    parts = F.split(netloc, r"\.", -1)
    return F.when(F.size(parts) > 1, py_capitalize(F.element_at(parts, -2))).otherwise(netloc)


def in_scope(url, base_url, scope: str = "prefix") -> Column:
    """F2 (and F3, which it implies).

    ``prefix`` (the reference): raw, case-sensitive string prefix, so
    ``http://a.co`` admits ``http://a.com/x``. ``authority``: the prefix and
    the same ``scheme://authority`` as the base.
    """
    pref = col(url).startswith(col(base_url))
    if scope == "prefix":
        return pref
    if scope == "authority":
        return pref & (site_of(url) == site_of(base_url))
    raise ValueError(f"unknown scope {scope!r}")


def excluded_suffix(url) -> Column:
    """URLs ending in one of the excluded suffixes (case-sensitive)."""
    url = col(url)
    out = F.lit(False)
    for s in EXCLUDED_SUFFIXES:
        out = out | F.endswith(url, F.lit(s))
    return out
