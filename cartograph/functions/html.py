"""Title and link extraction from raw HTML by regular expression.

Comments and the bodies of ``<script>``/``<style>`` are blanked first, so a
``</title>`` or ``<a href>`` inside them is not seen, as with an HTML parser.
"""

from __future__ import annotations

import html.entities

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ASCII_WS_CLASS as _W, col, py_strip

# --- fixed values -----------------------------------------------------------
# One left-to-right pass: a comment, a script body or a style body, each
# possibly cut off by the end of the page.
CLEAN_PATTERN = (
    r"(?is)<!--.*?(?:-->|\z)"
    rf"|<script\b.*?(?:</script{_W}*>|\z)"
    rf"|<style\b.*?(?:</style{_W}*>|\z)"
)
TITLE_PATTERN = rf"(?is)<title\b[^>]*>(.*?)</title{_W}*>"
# An <a> start tag with its attribute text; quoted values are units, so they may
# hold ">". The Java form never backtracks into what it has read (linear on
# broken pages, no recursion); RE2 in the DuckDB twin is linear as it is.
ANCHOR_PATTERN = r"""(?is)<a(?=[\t\n\r\f />])((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
ANCHOR_PATTERN_RE2 = r"""(?is)<a([\t\n\r\f /](?:[^>"']|"[^"]*"|'[^']*')*|)>"""
# One attribute: name, then optionally "=" and a quoted, bare or missing value.
ATTRIBUTE_PATTERN = r"""(?s)([^\s/>=][^\s/=>]*)(?:\s*=+\s*("[^"]*"|'[^']*'|[^\s>"'][^\s>]*|))?"""
# A child node inside <title>: start tag, end tag, comment or declaration.
NESTED_PATTERN = r"<[a-zA-Z/!?]"
ENTITY_TOKEN_PATTERN = r"&#[0-9]+;?|&#[xX][0-9a-fA-F]+;?|&[^\t\n\f <&#;]{1,32};?|[^&]+|&"
TITLE_STATES_KEPT = ("ok", "absent")
# ---------------------------------------------------------------------------


# HTML 5 names with their semicolon, and the old names that also count without one.
NAMED = {k: v for k, v in html.entities.html5.items() if k.endswith(";")}
OLD_NAMES = {k: v for k, v in html.entities.html5.items() if not k.endswith(";")}
OLD_NAME_PATTERN = "^&(" + "|".join(sorted(OLD_NAMES, key=lambda k: (-len(k), k))) + ")"     # longest first
# Numeric references that stand for another character: NUL, and 128-159 as Windows-1252 reads them.
REMAPPED = {0: "\ufffd", 13: "\r", **{n: bytes([n]).decode("cp1252", "replace").replace("\ufffd", chr(n)) for n in range(128, 160)}}
SEP = "\x01"      # occurs in no name and no value


def clean_html(html) -> Column:
    return F.regexp_replace(col(html), CLEAN_PATTERN, " ")


def _table(entries: dict) -> Column:
    """A constant map from two literals (folded once by the optimizer)."""
    return F.map_from_arrays(F.split(F.lit(SEP.join(map(str, entries))), SEP, -1),
                             F.split(F.lit(SEP.join(entries.values())), SEP, -1))


def _codepoint_char(n: Column) -> Column:
    """Character for a code point, via a UTF-32 byte string."""
    return F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")


def dropped_codepoint(n) -> Column:
    """References to these code points disappear: controls and noncharacters."""
    low = n.between(1, 8) | (n == 11) | n.between(14, 31) | (n == 127) | n.between(0xFDD0, 0xFDEF)
    return low | (n % 65536).isin(0xFFFE, 0xFFFF)


def _decode_token(t: Column) -> Column:
    dec = F.regexp_extract(t, r"^&#0*([0-9]+);?$", 1)
    hx = F.regexp_extract(t, r"^&#[xX]0*([0-9a-fA-F]+);?$", 1)
    too_long = (F.length(dec) > 7) | (F.length(hx) > 6)
    n = F.when(dec != "", F.substring(dec, 1, 7).cast("int")).when(hx != "", F.conv(F.substring(hx, 1, 6), 16, 10).cast("int"))
    old = F.regexp_extract(t, OLD_NAME_PATTERN, 1)
    number = (F.when(too_long | (n > 0x10FFFF) | n.between(0xD800, 0xDFFF), F.lit("\ufffd"))
              .when(F.try_element_at(_table(REMAPPED), n.cast("string")).isNotNull(), F.try_element_at(_table(REMAPPED), n.cast("string")))
              .when(dropped_codepoint(n), F.lit("")).otherwise(_codepoint_char(n)))
    name = F.try_element_at(_table(NAMED), F.substring(t, 2, 40))
    return (F.when(n.isNotNull(), number)
            .when(~t.startswith("&") | (F.length(t) == 1), t)
            .when(name.isNotNull(), name)
            .when(old != "", F.concat(F.try_element_at(_table(OLD_NAMES), old), F.substring(t, F.length(old) + 2, F.lit(40))))
            .otherwise(t))


def decode_entities(c) -> Column:
    """Numeric references, HTML 5 names, and old names without a semicolon (longest match)."""
    c = col(c)
    tokens = F.regexp_extract_all(c, F.lit(ENTITY_TOKEN_PATTERN), 0)
    decoded = F.array_join(F.transform(tokens, _decode_token), "")
    return F.when(c.contains("&"), decoded).otherwise(c)


def title_raw(clean) -> Column:
    return F.regexp_extract(col(clean), TITLE_PATTERN, 1)


def title_state(clean) -> Column:
    """``absent`` (no title: URL used), ``ok``, ``empty`` or ``nested``.

    ``empty`` and ``nested`` titles make the reference drop the page and not
    follow its links.
    """
    clean = col(clean)
    raw = title_raw(clean)
    return (
        F.when(~clean.rlike(TITLE_PATTERN), F.lit("absent"))
        .when(raw.rlike(NESTED_PATTERN), F.lit("nested"))
        .when(raw == "", F.lit("empty"))
        .otherwise(F.lit("ok"))
    )


def extract_title(clean, url) -> Column:
    """Stripped, decoded first title; the URL when there is none."""
    clean = col(clean)
    state = title_state(clean)
    return (
        F.when(state == "ok", py_strip(decode_entities(title_raw(clean))))
        .when(state == "absent", col(url))
    )


def unquoted(v: Column) -> Column:
    return F.when(v.rlike(r"(?s)^\".*\"\z|^'.*'\z") & (F.length(v) >= 2), F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(v)


def extract_hrefs(clean) -> Column:
    """The first ``href`` of every ``<a>``, in document order, unquoted and decoded."""
    tags = F.regexp_extract_all(col(clean), F.lit(ANCHOR_PATTERN), 1)
    pairs = F.transform(tags, lambda t: F.arrays_zip(
        F.regexp_extract_all(t, F.lit(ATTRIBUTE_PATTERN), 1).alias("n"), F.regexp_extract_all(t, F.lit(ATTRIBUTE_PATTERN), 2).alias("v")))
    hrefs = F.transform(pairs, lambda p: F.filter(p, lambda a: F.lower(a["n"]) == "href"))
    found = F.filter(hrefs, lambda p: F.size(p) > 0)
    return F.transform(found, lambda p: decode_entities(unquoted(F.coalesce(F.get(p, F.lit(0))["v"], F.lit("")))))
