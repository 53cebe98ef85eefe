"""DuckDB SQL twins of the column expressions in ``cartograph.functions``.

The oracle queries are single SELECT statements, so every helper returns an
SQL expression string. The regular expressions are the same constants the
Spark side uses; both Java regex and RE2 read them.
"""

from __future__ import annotations

from cartograph.functions import html as H
from cartograph.functions import text as T
from cartograph.functions import urls as U


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def str_list(items) -> str:
    return "[" + ", ".join(lit(i) for i in items) + "]"


# --- text -------------------------------------------------------------------

def py_strip(x: str) -> str:
    return f"regexp_replace({x}, {lit('^' + T.PY_WS_CLASS + '+|' + T.PY_WS_CLASS + '+' + chr(92) + 'z')}, '', 'g')"


def collapse_ws(x: str) -> str:
    return f"regexp_replace({x}, {lit(T.PY_WS_CLASS + '+')}, ' ', 'g')"


def py_capitalize(x: str) -> str:
    return f"(upper(substr({x}, 1, 1)) || lower(substr({x}, 2)))"


def py_title(x: str) -> str:
    return (f"array_to_string(list_transform(regexp_extract_all({x}, {lit(r'\p{L}+|\P{L}+')}), "
            f"lambda r: {py_capitalize('r')}), '')")


def link_line(title: str, url: str) -> str:
    return f"('- [' || {title} || '](' || {url} || ')')"


def strip_code_fence(x: str) -> str:
    s = py_strip(x)
    lines = f"string_split({s}, chr(10))"
    last_fence = f"{py_strip(f'{lines}[len({lines})]')} = '```'"
    body = (f"CASE WHEN {last_fence} THEN list_slice({lines}, 2, len({lines}) - 1) "
            f"ELSE list_slice({lines}, 2, len({lines})) END")
    return (f"CASE WHEN starts_with({s}, '```') THEN {py_strip(f'array_to_string({body}, chr(10))')} "
            f"ELSE {s} END")


# --- html -------------------------------------------------------------------

def clean_html(x: str) -> str:
    return f"regexp_replace({x}, {lit(H.CLEAN_PATTERN)}, ' ', 'g')"


def _table(entries: dict) -> str:
    return (f"map(string_split({lit(H.SEP.join(map(str, entries)))}, chr(1)), "
            f"string_split({lit(H.SEP.join(entries.values()))}, chr(1)))")


def _decode_token(t: str) -> str:
    dec = f"regexp_extract({t}, '^&#0*([0-9]+);?$', 1)"
    hx = f"regexp_extract({t}, '^&#[xX]0*([0-9a-fA-F]+);?$', 1)"
    n = (f"(CASE WHEN {dec} <> '' THEN CAST(substr({dec}, 1, 7) AS INTEGER) "
         f"WHEN {hx} <> '' THEN CAST('0x' || substr({hx}, 1, 6) AS INTEGER) END)")
    old = f"regexp_extract({t}, {lit(H.OLD_NAME_PATTERN)}, 1)"
    gone = (f"({n} BETWEEN 1 AND 8 OR {n} IN (11, 127) OR {n} BETWEEN 14 AND 31 OR {n} BETWEEN 64976 AND 65007 "
            f"OR {n} % 65536 IN (65534, 65535))")
    return (f"CASE WHEN {n} IS NOT NULL THEN CASE WHEN length({dec}) > 7 OR length({hx}) > 6 OR {n} > 1114111 "
            f"OR {n} BETWEEN 55296 AND 57343 THEN chr(65533) "
            f"WHEN {_table(H.REMAPPED)}[CAST({n} AS VARCHAR)] IS NOT NULL THEN {_table(H.REMAPPED)}[CAST({n} AS VARCHAR)] "
            f"WHEN {gone} THEN '' ELSE chr({n}) END "
            f"WHEN NOT starts_with({t}, '&') OR length({t}) = 1 THEN {t} "
            f"WHEN {_table(H.NAMED)}[substr({t}, 2)] IS NOT NULL THEN {_table(H.NAMED)}[substr({t}, 2)] "
            f"WHEN {old} <> '' THEN {_table(H.OLD_NAMES)}[{old}] || substr({t}, length({old}) + 2) ELSE {t} END")


def decode_entities(x: str) -> str:
    return (f"CASE WHEN contains({x}, '&') THEN array_to_string(list_transform("
            f"regexp_extract_all({x}, {lit(H.ENTITY_TOKEN_PATTERN)}), lambda tk: {_decode_token('tk')}), '') "
            f"ELSE {x} END")


def title_state(clean: str) -> str:
    raw = f"regexp_extract({clean}, {lit(H.TITLE_PATTERN)}, 1)"
    return (f"CASE WHEN NOT regexp_matches({clean}, {lit(H.TITLE_PATTERN)}) THEN 'absent' "
            f"WHEN regexp_matches({raw}, {lit(H.NESTED_PATTERN)}) THEN 'nested' "
            f"WHEN {raw} = '' THEN 'empty' ELSE 'ok' END")


def extract_title(clean: str, state: str, url: str) -> str:
    raw = f"regexp_extract({clean}, {lit(H.TITLE_PATTERN)}, 1)"
    return f"CASE WHEN {state} = 'ok' THEN {py_strip(decode_entities(raw))} WHEN {state} = 'absent' THEN {url} END"


def extract_hrefs(clean: str) -> str:
    attr = lit(H.ATTRIBUTE_PATTERN)
    pairs = (f"list_zip(list_transform(regexp_extract_all(tg, {attr}, 1), lambda an: lower(an)), "
             f"regexp_extract_all(tg, {attr}, 2))")
    hrefs = (f"list_filter(list_transform(regexp_extract_all({clean}, {lit(H.ANCHOR_PATTERN_RE2)}, 1), "
             f"lambda tg: list_filter({pairs}, lambda ap: ap[1] = 'href')), lambda fp: len(fp) > 0)")
    value = "coalesce(fv[1][2], '')"
    unq = (f"""CASE WHEN regexp_matches({value}, '(?s)^".*"\\z|^''.*''\\z') AND length({value}) >= 2 """
           f"THEN substr({value}, 2, length({value}) - 2) ELSE {value} END")
    return f"list_transform(list_transform({hrefs}, lambda fv: {unq}), lambda hv: {decode_entities('hv')})"


# --- urls -------------------------------------------------------------------

def staged(src: str, stages: list[list[str]]) -> str:
    """Nest one ``SELECT *, ...`` per stage so each column is computed once."""
    sql = src
    for i, items in enumerate(stages):
        sql = f"SELECT *, {', '.join(items)} FROM ({sql}) AS st{i}"
    return sql


def merge_stages(*groups: list[list[str]]) -> list[list[str]]:
    """Run stage lists side by side (stage k of each group together)."""
    depth = max(len(g) for g in groups)
    return [[it for g in groups if k < len(g) for it in g[k]] for k in range(depth)]


def split_stages(src: str, p: str, default_scheme: str | None = None) -> list[list[str]]:
    """Stages computing ``urlsplit(src)`` into ``{p}_scheme``, ``{p}_netloc`` ..."""
    rest = U.REST_PATTERN
    return [
        [f"regexp_replace(regexp_replace({src}, '^[\\x{{00}}-\\x{{20}}]+', ''), '[\\t\\r\\n]', '', 'g') AS {p}_s"],
        [f"lower(regexp_extract({p}_s, {lit(U.SCHEME_PATTERN)}, 1)) AS {p}_sch0"],
        [f"CASE WHEN {p}_sch0 <> '' THEN substr({p}_s, length({p}_sch0) + 2) ELSE {p}_s END AS {p}_rest"],
        [(f"CASE WHEN {p}_sch0 <> '' THEN {p}_sch0 ELSE {default_scheme} END AS {p}_scheme"
          if default_scheme else f"{p}_sch0 AS {p}_scheme"),
         f"regexp_extract({p}_rest, {lit(rest)}, 2) AS {p}_netloc",
         f"regexp_extract({p}_rest, {lit(rest)}, 3) AS {p}_path",
         f"regexp_extract({p}_rest, {lit(rest)}, 5) AS {p}_query",
         f"regexp_extract({p}_rest, {lit(rest)}, 7) AS {p}_frag"],
    ]


def unsplit(scheme: str, netloc: str, path: str, query: str, frag: str) -> str:
    netlocs = str_list(U.USES_NETLOC)
    body = (f"(CASE WHEN {netloc} <> '' THEN '//' || {netloc} || "
            f"(CASE WHEN {path} <> '' AND NOT starts_with({path}, '/') THEN '/' || {path} ELSE {path} END) "
            f"WHEN starts_with({path}, '//') THEN '//' || {path} "
            f"WHEN {scheme} <> '' AND list_contains({netlocs}, {scheme}) AND ({path} = '' OR starts_with({path}, '/')) "
            f"THEN '//' || {path} ELSE {path} END)")
    return (f"((CASE WHEN {scheme} <> '' THEN {scheme} || ':' || {body} ELSE {body} END) || "
            f"(CASE WHEN {query} <> '' THEN '?' || {query} ELSE '' END) || "
            f"(CASE WHEN {frag} <> '' THEN '#' || {frag} ELSE '' END))")


def resolve_stages(base: str, href: str, out: str, p: str = "rz") -> list[list[str]]:
    """Stages computing ``urljoin(base, href) AS out``."""
    b, u = f"{p}b", f"{p}u"
    bs = split_stages(base, b)
    us = split_stages(href, u, default_scheme=f"{b}_scheme")
    stages = merge_stages(bs, us)
    rel = str_list(U.USES_RELATIVE)
    net = str_list(U.USES_NETLOC)
    stages += [
        [f"list_contains({net}, {u}_scheme) AS {p}_innet",
         f"string_split({b}_path, '/') AS {p}_bparts",
         f"string_split({u}_path, '/') AS {p}_uparts"],
        [f"CASE WHEN {p}_innet THEN {b}_netloc ELSE {u}_netloc END AS {p}_netloc",
         (f"list_concat(CASE WHEN {p}_bparts[len({p}_bparts)] <> '' THEN list_slice({p}_bparts, 1, len({p}_bparts) - 1) "
          f"ELSE {p}_bparts END, {p}_uparts) AS {p}_rel0")],
        [(f"CASE WHEN starts_with({u}_path, '/') THEN {p}_uparts "
          f"WHEN len({p}_rel0) > 2 THEN list_concat([{p}_rel0[1]], "
          f"list_filter(list_slice({p}_rel0, 2, len({p}_rel0) - 1), lambda sg: sg <> ''), "
          f"[{p}_rel0[len({p}_rel0)]]) ELSE {p}_rel0 END AS {p}_segs")],
        [(f"array_to_string(CASE WHEN {p}_segs[len({p}_segs)] IN ('.', '..') THEN list_append("
          f"list_reduce({p}_segs, lambda acc, sg: CASE WHEN sg = '..' THEN list_slice(acc, 1, len(acc) - 1) "
          f"WHEN sg = '.' THEN acc ELSE list_append(acc, sg) END, []::VARCHAR[]), '') "
          f"ELSE list_reduce({p}_segs, lambda acc, sg: CASE WHEN sg = '..' THEN list_slice(acc, 1, len(acc) - 1) "
          f"WHEN sg = '.' THEN acc ELSE list_append(acc, sg) END, []::VARCHAR[]) END, '/') AS {p}_joined")],
        [(f"CASE WHEN starts_with({u}_path, '/') AND NOT regexp_matches({u}_path, '(^|/)\\.\\.?(/|\\z)') "
          f"THEN {u}_path WHEN {p}_joined = '' THEN '/' ELSE {p}_joined END AS {p}_mpath")],
    ]
    stages.append([
        (f"CASE WHEN {href} = '' THEN {base} "
         f"WHEN {u}_scheme <> {b}_scheme OR NOT list_contains({rel}, {u}_scheme) THEN {href} "
         f"WHEN {p}_innet AND {u}_netloc <> '' THEN "
         f"{unsplit(f'{u}_scheme', f'{u}_netloc', f'{u}_path', f'{u}_query', f'{u}_frag')} "
         f"WHEN {u}_path = '' THEN "
         f"{unsplit(f'{u}_scheme', f'{p}_netloc', f'{b}_path', f"(CASE WHEN {u}_query <> '' THEN {u}_query ELSE {b}_query END)", f'{u}_frag')} "
         f"ELSE {unsplit(f'{u}_scheme', f'{p}_netloc', f'{p}_mpath', f'{u}_query', f'{u}_frag')} END AS {out}"),
    ])
    return stages


def site_of(url: str) -> str:
    return f"regexp_extract({url}, {lit(U.SITE_PATTERN)}, 1)"


def section_stages(url: str, out: str, p: str = "sk") -> list[list[str]]:
    return split_stages(url, p) + [
        [f"regexp_replace(regexp_replace({p}_path, ';[^/]*\\z', ''), '^/+|/+\\z', '', 'g') AS {p}_stripped"],
        [f"CASE WHEN split_part({p}_stripped, '/', 1) = '' THEN {lit(U.HOME_SECTION)} "
         f"ELSE split_part({p}_stripped, '/', 1) END AS {out}"],
    ]


def section_label(slug: str) -> str:
    return py_title(f"translate({slug}, '-_', '  ')")


def site_name_stages(base: str, out: str, p: str = "sn") -> list[list[str]]:
    return split_stages(base, p) + [
        [f"string_split({p}_netloc, '.') AS {p}_parts"],
        [f"CASE WHEN len({p}_parts) > 1 THEN {py_capitalize(f'{p}_parts[len({p}_parts) - 1]')} "
         f"ELSE {p}_netloc END AS {out}"],
    ]


def excluded_suffix(url: str) -> str:
    return "(" + " OR ".join(f"ends_with({url}, {lit(s)})" for s in U.EXCLUDED_SUFFIXES) + ")"


# --- site-map documents -----------------------------------------------------

def first_replace(s: str, old: str, new_sql: str) -> str:
    return (f"(CASE WHEN instr({s}, {lit(old)}) > 0 THEN substr({s}, 1, instr({s}, {lit(old)}) - 1) || {new_sql} "
            f"|| substr({s}, instr({s}, {lit(old)}) + {len(old)}) ELSE {s} END)")


def line_kind(line: str) -> str:
    from cartograph.operators import conform as C
    whens = " ".join(f"WHEN regexp_matches({line}, {lit(p)}) THEN {lit(k)}" for k, p in C.LINE_KINDS)
    return f"(CASE {whens} WHEN {py_strip(line)} = '' THEN 'blank' ELSE 'text' END)"


def url_key(url: str) -> str:
    head = f"lower(regexp_extract({url}, '^([a-zA-Z][a-zA-Z0-9+.\\-]*://[^/?#]*)', 1))"
    rest = f"regexp_extract({url}, '^[a-zA-Z][a-zA-Z0-9+.\\-]*://[^/?#]*([^#]*)', 1)"
    path = f"regexp_replace(regexp_extract({rest}, '^([^?]*)', 1), '(/index)?\\.html?$|/+$', '', 'g')"
    query = f"regexp_extract({rest}, '\\?(.*)$', 1)"
    kept = (f"array_to_string(list_filter(string_split({query}, '&'), "
            f"lambda qp: qp <> '' AND NOT starts_with(qp, 'utm_')), '&')")
    return f"({head} || {path} || (CASE WHEN {kept} <> '' THEN '?' || {kept} ELSE '' END))"


# --- model replies ----------------------------------------------------------

def unfence(raw: str) -> str:
    from cartograph.functions import jsonparse as J
    return (f"(CASE WHEN regexp_matches({raw}, {lit(J.FENCE_PATTERN)}) "
            f"THEN regexp_extract({raw}, {lit(J.FENCE_PATTERN)}, 1) ELSE {raw} END)")


def bracket_slice(s: str, o: str, c: str) -> str:
    start = f"instr({s}, {lit(o)})"
    rpos = f"instr(reverse({s}), {lit(c)})"
    end = f"(length({s}) - {rpos} + 1)"
    return (f"(CASE WHEN {start} = 0 OR {rpos} = 0 THEN {s} WHEN {end} >= {start} "
            f"THEN substr({s}, {start}, {end} - {start} + 1) ELSE '' END)")


def has_brackets(s: str, o: str, c: str) -> str:
    return f"(instr({s}, {lit(o)}) > 0 AND instr({s}, {lit(c)}) > 0)"


def single_value(s: str) -> str:
    """One JSON value by DuckDB's own parser, which lets a trailing comma pass: that is ruled out outside strings."""
    bare = f"regexp_replace(regexp_replace({s}, {lit(r'(?s)\\.')}, '__', 'g'), {lit(r'"[^"]*"')}, '0', 'g')"
    return f"(json_valid({s}) AND NOT regexp_matches({bare}, {lit(r',[\t\n\r ]*[\]}]')}))"


def json_number(s: str, path: str) -> str:
    return (f"(CASE WHEN json_valid({s}) AND json_type({s}, {lit(path)}) IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'HUGEINT') "
            f"THEN CAST(json_extract({s}, {lit(path)}) AS DOUBLE) END)")
