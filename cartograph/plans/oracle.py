"""DuckDB twins of the named queries (single SELECT statements)."""

from __future__ import annotations

from cartograph.operators.sitemap import DEFAULT_MAX_PAGES
from cartograph.plans import duck as D

ORACLE: dict[str, str] = {}

NL = "chr(10)"


def _index_sql() -> str:
    """page_index: one row per URL (lowest page_id), extracted columns + clean html."""
    src = ("SELECT page_id, url, html FROM pages "
           "QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id) = 1")
    return D.staged(src, [
        [f"{D.clean_html('html')} AS clean", f"{D.site_of('url')} AS site"],
        [f"{D.title_state('clean')} AS title_state"],
        [f"{D.extract_title('clean', 'title_state', 'url')} AS title"],
    ])


def _links_sql() -> str:
    src = (f"SELECT site, url AS src_url, unnest({D.extract_hrefs('clean')}) AS href, "
           f"unnest(range(len({D.extract_hrefs('clean')}))) AS pos "
           f"FROM ({_index_sql()}) AS ix WHERE title_state IN ('ok', 'absent')")
    return D.staged(src, D.resolve_stages("src_url", "href", "dst_url"))


def _ranked_sql(max_pages: int | None = None) -> str:
    cut = "" if max_pages is None else f"QUALIFY rank <= {max_pages}"
    return (f"SELECT site, url, title, page_id, row_number() OVER (PARTITION BY site ORDER BY page_id) AS rank "
            f"FROM ({_index_sql()}) AS ix WHERE title_state IN ('ok', 'absent') AND site <> '' {cut}")


def _rows_sql(max_pages: int | None = None) -> str:
    return D.staged(_ranked_sql(max_pages), D.section_stages("url", "section") + [
        [f"{D.section_label('section')} AS label",
         f"{D.link_line(D.collapse_ws('title'), 'url')} AS line"],
    ])


def _seeds_sql() -> str:
    return D.staged("SELECT DISTINCT site, site AS base_url FROM (" + _ranked_sql() + ") AS r",
                    D.site_name_stages("base_url", "site_name"))


ORACLE["page_titles"] = f"SELECT page_id, url, site, title_state, title FROM ({_index_sql()}) AS q"

ORACLE["page_links"] = f"SELECT site, src_url, CAST(pos AS INTEGER) AS pos, href, dst_url FROM ({_links_sql()}) AS q"

ORACLE["links_in_scope"] = f"""
SELECT site, count(*) AS n_links,
       count(*) FILTER (WHERE starts_with(dst_url, site)) AS n_in_scope,
       count(*) FILTER (WHERE {D.excluded_suffix('dst_url')}) AS n_excluded,
       count(*) FILTER (WHERE starts_with(dst_url, site) AND NOT {D.excluded_suffix('dst_url')}) AS n_followable
FROM ({_links_sql()}) AS q GROUP BY site"""

ORACLE["site_names"] = f"SELECT site, base_url, site_name FROM ({_seeds_sql()}) AS q"

ORACLE["section_counts"] = f"""
SELECT site, section, label, count(*) AS n_pages FROM ({_rows_sql()}) AS q GROUP BY site, section, label"""

ORACLE["sitemap_links_ordered"] = f"""
SELECT site, section,
       dense_rank() OVER (PARTITION BY site ORDER BY section <> 'Home', section) AS section_ord,
       row_number() OVER (PARTITION BY site, section ORDER BY length(url), rank) AS link_ord,
       url, line
FROM ({_rows_sql()}) AS q"""

def _documents_sql(max_pages: int | None = None) -> str:
    return f"""
WITH sec AS (
  SELECT site, section, count(*) AS n_pages,
         '## ' || label || {NL} || {NL} || string_agg(line || {NL}, '' ORDER BY length(url), rank) || {NL} AS text
  FROM ({_rows_sql(max_pages)}) AS q GROUP BY site, section, label
), per_site AS (
  SELECT site, string_agg(text, '' ORDER BY section <> 'Home', section) AS body,
         sum(n_pages) AS n_pages, count(*) AS n_sections
  FROM sec GROUP BY site
)
SELECT p.site, s.base_url, s.site_name, CAST(p.n_pages AS BIGINT) AS n_pages,
       CAST(p.n_sections AS BIGINT) AS n_sections,
       '# ' || s.site_name || {NL} || {NL} || '> Site map of ' || s.site_name || ' (' || s.base_url
       || '), auto-generated for LLM context.' || {NL} || {NL} || p.body AS doc
FROM per_site p JOIN ({_seeds_sql()}) s ON p.site = s.site"""


ORACLE["sitemap_documents"] = _documents_sql()

ORACLE["sitemap_lines"] = f"""
WITH docs AS ({ORACLE["sitemap_documents"]}),
cut AS (SELECT site, unnest(string_split(doc, {NL})) AS line,
               CAST(unnest(range(len(string_split(doc, {NL})))) AS BIGINT) AS n, len(string_split(doc, {NL})) AS lines FROM docs),
marked AS (SELECT site, line, n,
                  sum(CASE WHEN n >= 4 AND starts_with(line, '## ') THEN 1 ELSE 0 END)
                    OVER (PARTITION BY site ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section_ord
           FROM cut WHERE n < lines - 1)
SELECT site, CAST(section_ord AS BIGINT) AS section_ord,
       row_number() OVER (PARTITION BY site, section_ord ORDER BY n) - CASE WHEN section_ord = 0 THEN 1 ELSE 2 END AS link_ord,
       line FROM marked"""


def _site_pages_sql() -> str:
    return (f"SELECT site, url, title, page_id, row_number() OVER (PARTITION BY site ORDER BY page_id) - 1 AS r "
            f"FROM ({_index_sql()}) AS ix WHERE title_state IN ('ok', 'absent') AND site <> ''")


# Derived tree: FIFO order equals r order, so the answer is r < max_pages.
ORACLE["bfs_pages"] = f"""
SELECT site, url, title, r + 1 AS rank FROM ({_site_pages_sql()}) AS q WHERE r < {DEFAULT_MAX_PAGES}"""

ORACLE["bfs_limit_per_site"] = f"""
SELECT site, url, title, r + 1 AS rank FROM ({_site_pages_sql()}) AS q WHERE r < 1 + length(site) % 4"""

# Planted links form the same tree with failed pages: reached pages in r order.
ORACLE["bfs_planted_links"] = f"""
WITH RECURSIVE sp AS MATERIALIZED ({_site_pages_sql()}),
t AS (SELECT site, r FROM sp WHERE r = 0
      UNION ALL SELECT sp.site, sp.r FROM t JOIN sp ON sp.site = t.site AND (sp.r - 1) // 2 = t.r WHERE sp.r > 0 AND sp.r % 7 <> 5)
SELECT sp.site, sp.url, sp.title, row_number() OVER (PARTITION BY sp.site ORDER BY sp.r) AS rank
FROM t JOIN sp ON sp.site = t.site AND sp.r = t.r QUALIFY rank <= {DEFAULT_MAX_PAGES}"""

# Captured links never resolve to another captured page: only the seed is found.
ORACLE["bfs_captured_links"] = f"""
SELECT site, url, title, CAST(1 AS BIGINT) AS rank FROM ({_site_pages_sql()}) AS q WHERE r = 0"""


def _variants_sql() -> str:
    from cartograph.operators import conform as C  # noqa: F401 (patterns shared)
    docs = ORACLE["sitemap_documents"]
    d = "doc"
    link_start = f"instr({d}, {NL} || '- [')"
    after = f"substr({d}, {link_start} + 1)"
    first_link = f"split_part({after}, {NL}, 1)"
    dropped = (f"CASE WHEN {link_start} > 0 THEN substr({d}, 1, {link_start}) || "
               f"substr({after}, length({first_link}) + 2) ELSE {d} END")
    link_line = r"'(?m)^(- \[.*\]\(https?://.*\))$'"
    described = f"regexp_replace({d}, {link_line}, '\\1: Short page description', 'g')"
    long_desc = f"regexp_replace({d}, {link_line}, '\\1: {' '.join(['word'] * 16)}', 'g')"
    optional = f"'## Optional' || {NL} || {NL} || '- [More pages](' || base_url || '/more)' || {NL} || {NL}"
    variants = [
        ("basic", d),
        ("fenced", f"'```markdown' || {NL} || {d} || '```'"),
        ("json_metadata", f"{d} || '{{\"generated_by\": \"model\", \"pages\": ' || CAST(length({d}) AS VARCHAR) || '}}' || {NL}"),
        ("deep_heading", D.first_replace(d, "\n## ", f"{NL} || '### '")),
        ("link_dropped", dropped),
        ("link_invented", f"{d} || '- [Invented page](' || base_url || '/invented-page)' || {NL}"),
        ("duplicate", f"{d} || {first_link} || {NL}"),
        ("described", described),
        ("long_description", long_desc),
        ("with_optional", f"{described} || {optional}"),
        ("optional_not_last", D.first_replace(
            f"({described})", "\n## ",
            f"{NL} || '## Optional' || {NL} || {NL} || '- [More pages](' || base_url || '/more)' || {NL} || {NL} || '## '")),
    ]
    return " UNION ALL ".join(
        f"SELECT site, base_url, {D.lit(name)} AS variant, {expr} AS doc FROM ({docs}) AS dq" for name, expr in variants)


def _line_table_sql() -> str:
    from cartograph.operators import conform as C
    exploded = (f"SELECT site, variant, unnest(string_split(doc, {NL})) AS line, "
                f"CAST(unnest(range(1, len(string_split(doc, {NL})) + 1)) AS INTEGER) AS line_no "
                f"FROM ({_variants_sql()}) AS v")
    return D.staged(exploded, [
        [f"{D.line_kind('line')} AS kind"],
        [f"last_value(CASE WHEN kind = 'h2' THEN {D.py_strip('substr(line, 4)')} END IGNORE NULLS) OVER "
         f"(PARTITION BY site, variant ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section",
         f"CASE WHEN kind = 'link' THEN regexp_extract(line, {D.lit(C.LINK_PATTERN)}, 1) END AS title",
         f"CASE WHEN kind = 'link' THEN regexp_extract(line, {D.lit(C.LINK_PATTERN)}, 2) END AS url",
         f"CASE WHEN kind = 'link' THEN regexp_extract(line, {D.lit(C.LINK_PATTERN)}, 3) END AS description"],
    ])


ORACLE["map_line_table"] = f"""
SELECT site, variant, line_no, kind, section, title, url, description FROM ({_line_table_sql()}) AS q"""


def _conformance_sql() -> str:
    from cartograph.operators import conform as C
    nonws = D.lit(C.NON_WS)
    return f"""
WITH lt AS ({_line_table_sql()}),
l2 AS (
  SELECT *, kind = 'quote' AND coalesce(lag(kind) OVER (PARTITION BY site, variant ORDER BY line_no), '') <> 'quote'
            AS quote_start,
         kind = 'quote' AND coalesce(last_value(CASE WHEN kind <> 'blank' THEN kind END IGNORE NULLS) OVER
            (PARTITION BY site, variant ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') = 'h1'
            AS quote_below_h1,
         min(CASE WHEN kind = 'h2' THEN line_no END) OVER (PARTITION BY site, variant) AS first_h2
  FROM lt)
SELECT site, variant, count(*) AS n_lines,
  count(*) FILTER (WHERE kind = 'h1') AS n_h1,
  coalesce(max(CASE WHEN line_no = 1 THEN kind = 'h1' END), false) AS h1_first,
  count(*) FILTER (WHERE quote_start) AS n_quote_blocks,
  count(*) FILTER (WHERE quote_below_h1) AS n_quotes_below_h1,
  count(*) FILTER (WHERE kind = 'h2') AS n_h2,
  count(*) FILTER (WHERE kind = 'deep') AS n_deep,
  count(*) FILTER (WHERE kind IN ('h1', 'deep') AND line_no > 1 AND (first_h2 IS NULL OR line_no < first_h2))
    AS n_intro_headings,
  count(*) FILTER (WHERE kind = 'link') AS n_links,
  count(*) FILTER (WHERE kind = 'link' AND description = '') AS n_links_no_desc,
  count(*) FILTER (WHERE kind = 'link' AND len(regexp_extract_all(description, {nonws})) >= {C.MAX_DESCRIPTION_WORDS})
    AS n_long_desc,
  count(*) FILTER (WHERE kind = 'bullet') AS n_bullets,
  count(*) FILTER (WHERE kind = 'text' AND section IS NOT NULL) AS n_section_text,
  count(*) FILTER (WHERE kind = 'fence') AS n_fence,
  count(*) FILTER (WHERE kind = 'json') AS n_json,
  count(*) FILTER (WHERE kind = 'h2' AND section = {D.lit(C.OPTIONAL_SECTION)}) > 0 AS has_optional,
  coalesce(arg_max(CASE WHEN kind = 'h2' THEN section END, CASE WHEN kind = 'h2' THEN line_no END)
           = {D.lit(C.OPTIONAL_SECTION)}, false) AS optional_last
FROM l2 GROUP BY site, variant"""


ORACLE["map_conformance"] = f"""
SELECT *, (n_h1 = 1 AND h1_first AND n_quote_blocks = 1 AND n_quotes_below_h1 = 1 AND n_section_text = 0 AND n_deep = 0 AND n_intro_headings = 0 AND n_h2 > 0
           AND n_links_no_desc = 0 AND n_long_desc = 0 AND n_bullets = 0 AND n_fence = 0 AND n_json = 0 AND has_optional
           AND optional_last) AS ok
FROM ({_conformance_sql()}) AS c"""

# rows end where the text does: the string's last newline starts no line
ORACLE["map_lines_conformance"] = f"""
SELECT * EXCLUDE (variant) REPLACE (n_lines - 1 AS n_lines) FROM ({ORACLE['map_conformance']}) AS c WHERE variant = 'basic'"""

ORACLE["map_url_preservation"] = f"""
WITH lt AS ({_line_table_sql()}),
src AS (SELECT DISTINCT b.site, v.variant, b.url, true AS in_s FROM lt b
        JOIN (SELECT DISTINCT site, variant FROM lt) v ON b.site = v.site
        WHERE b.variant = 'basic' AND b.kind = 'link'),
tgt AS (SELECT DISTINCT site, variant, url, true AS in_t FROM lt WHERE kind = 'link')
SELECT site, variant,
  count(*) FILTER (WHERE in_s AND in_t IS NULL) AS n_lost,
  count(*) FILTER (WHERE in_t AND in_s IS NULL) AS n_invented,
  count(*) FILTER (WHERE in_s AND in_t) AS n_kept
FROM src FULL OUTER JOIN tgt USING (site, variant, url) GROUP BY site, variant"""

ORACLE["map_exact_duplicates"] = f"""
SELECT site, variant, url, count(*) AS n_entries FROM ({_line_table_sql()}) AS q
WHERE kind = 'link' GROUP BY site, variant, url HAVING count(*) > 1"""

ORACLE["map_near_duplicates"] = f"""
SELECT site, variant, url_key, count(*) AS n_entries, count(DISTINCT url) AS n_urls
FROM (SELECT *, {D.url_key('url')} AS url_key FROM ({_line_table_sql()}) AS q WHERE kind = 'link') AS k
GROUP BY site, variant, url_key HAVING count(DISTINCT url) > 1"""


def _judge_sql() -> str:
    from cartograph.functions import jsonparse as J
    from cartograph.sources import fixtures as FX
    raw = ", ".join(f"{expr} AS {name}" for name, expr in FX.JUDGE_COLUMNS.items())
    src = f"SELECT {raw} FROM events"
    scores = [f"{D.json_number('s2', f'$.{a}.{c}')} AS sc_{a[0]}_{c}" for a in J.ARMS for c in J.CRITERIA]
    all_num = " AND ".join(f"sc_{a[0]}_{c} IS NOT NULL" for a in J.ARMS for c in J.CRITERIA)
    notes = [f"CASE WHEN json_valid(s2) THEN json_extract_string(s2, '$.{a}.notes') END AS nt_{a[0]}" for a in J.ARMS]
    reason = (f"CASE WHEN NOT {D.has_brackets('s1', '{', '}')} THEN 'no_object' "
              f"WHEN NOT (CASE WHEN json_valid(s2) THEN json_type(s2) = 'OBJECT' AND {D.single_value('s2')} ELSE false END) "
              f"THEN 'not_strict_json' "
              f"WHEN NOT ({all_num}) THEN 'bad_scores' ELSE 'ok' END AS reason")
    st = D.staged(src, [
        [f"{D.unfence('raw')} AS s1"],
        [f"{D.bracket_slice('s1', '{', '}')} AS s2"],
        scores + notes,
        [reason],
    ])
    out = [f"CASE WHEN reason = 'ok' THEN sc_{a[0]}_{c} END AS {a[0]}_{c}" for a in J.ARMS for c in J.CRITERIA]
    out += [f"CASE WHEN reason = 'ok' THEN nt_{a[0]} END AS {a[0]}_notes" for a in J.ARMS]
    return (f"SELECT run_id, query_id, coalesce(category, 'general') AS category, reason, {', '.join(out)} "
            f"FROM ({st}) AS j")


def _sum_arm(a: str) -> str:
    from cartograph.functions import jsonparse as J
    return "(" + " + ".join(f"{a[0]}_{c}" for c in J.CRITERIA) + ")"


ORACLE["judge_parse"] = _judge_sql()

ORACLE["judge_failures"] = f"SELECT run_id, reason, count(*) AS n FROM ({_judge_sql()}) AS q GROUP BY run_id, reason"

ORACLE["criterion_means"] = f"""
WITH lg AS (
  SELECT run_id, query_id, unnest(['baseline', 'baseline', 'baseline', 'baseline',
                                   'enhanced', 'enhanced', 'enhanced', 'enhanced']) AS arm,
         unnest(['accuracy', 'completeness', 'specificity', 'actionability',
                 'accuracy', 'completeness', 'specificity', 'actionability']) AS criterion,
         unnest([b_accuracy, b_completeness, b_specificity, b_actionability,
                 e_accuracy, e_completeness, e_specificity, e_actionability]) AS score
  FROM ({_judge_sql()}) AS q WHERE reason = 'ok')
SELECT run_id, criterion, n, sb / n AS baseline_mean, se / n AS enhanced_mean, se / n - sb / n AS delta
FROM (SELECT run_id, criterion, sum(score) FILTER (WHERE arm = 'baseline') AS sb,
             sum(score) FILTER (WHERE arm = 'enhanced') AS se, count(*) FILTER (WHERE arm = 'baseline') AS n
      FROM lg GROUP BY run_id, criterion) AS g"""

ORACLE["overall_improvement"] = f"""
SELECT run_id, n_queries, b AS overall_baseline, e AS overall_enhanced, e - b AS overall_delta,
       CASE WHEN b > 0 THEN (e - b) / b * 100 END AS improvement_pct
FROM (SELECT run_id, n_queries, tb / (n_queries * 4) AS b, te / (n_queries * 4) AS e
      FROM (SELECT run_id, count(*) AS n_queries, sum({_sum_arm('baseline')}) AS tb, sum({_sum_arm('enhanced')}) AS te
            FROM ({_judge_sql()}) AS q WHERE reason = 'ok' GROUP BY run_id) AS g) AS h"""

ORACLE["query_deltas"] = f"""
SELECT run_id, query_id, category, {_sum_arm('baseline')} / 4.0 AS baseline_mean,
       {_sum_arm('enhanced')} / 4.0 AS enhanced_mean,
       {_sum_arm('enhanced')} / 4.0 - {_sum_arm('baseline')} / 4.0 AS delta,
       e_accuracy - b_accuracy AS d_accuracy, e_completeness - b_completeness AS d_completeness,
       e_specificity - b_specificity AS d_specificity, e_actionability - b_actionability AS d_actionability
FROM ({_judge_sql()}) AS q WHERE reason = 'ok'"""

ORACLE["pooled_means"] = f"""
SELECT run_id, n_input, n_tested, n_input - n_tested AS n_dropped, b AS pooled_baseline, e AS pooled_enhanced,
       CASE WHEN b > 0 THEN (e - b) / b * 100 ELSE 0.0 END AS console_pct
FROM (SELECT run_id, n_input, n_tested, tb / (n_tested * 4) AS b, te / (n_tested * 4) AS e
      FROM (SELECT run_id, count(*) AS n_input, count(*) FILTER (WHERE reason = 'ok') AS n_tested,
                   sum(CASE WHEN reason = 'ok' THEN {_sum_arm('baseline')} END) AS tb,
                   sum(CASE WHEN reason = 'ok' THEN {_sum_arm('enhanced')} END) AS te
            FROM ({_judge_sql()}) AS q GROUP BY run_id) AS g) AS h"""


def _tok(x: str) -> str:
    from cartograph.operators import coverage as K
    return f"list_distinct(regexp_extract_all(lower({x}), {D.lit(K.TOKEN_PATTERN)}))"


_FACT_PAIRS = f"""
WITH d AS (SELECT doc_id, {_tok('text')} AS toks FROM documents),
f AS (SELECT item_id, {_tok('text')} AS toks FROM benchmark WHERE len({_tok('text')}) > 0)
SELECT d.doc_id, f.item_id, CAST(len(f.toks) AS INTEGER) AS n_tokens FROM d, f WHERE list_has_all(d.toks, f.toks)"""

ORACLE["fact_coverage"] = _FACT_PAIRS

ORACLE["response_coverage"] = f"""
WITH c AS (SELECT doc_id, count(*) AS n_covered FROM ({_FACT_PAIRS}) AS p GROUP BY doc_id),
n AS (SELECT count(*) AS n_facts FROM benchmark WHERE len({_tok('text')}) > 0)
SELECT d.doc_id, coalesce(c.n_covered, 0) AS n_covered, n.n_facts, coalesce(c.n_covered, 0) / n.n_facts AS coverage
FROM documents d LEFT JOIN c ON d.doc_id = c.doc_id, n"""


def _count(p: str) -> str:
    return f"CAST(len(regexp_extract_all(text, {D.lit(p)})) AS BIGINT)"


def _signals_sql() -> str:
    from cartograph.operators import coverage as K
    return (f"SELECT doc_id, {_count(K.URL_PATTERN)} AS n_urls, {_count(K.EMAIL_PATTERN)} AS n_emails, "
            f"{_count(K.NUMBER_PATTERN)} AS n_numbers, {_count(K.MD_LINK_PATTERN)} AS n_md_links FROM documents")


ORACLE["signal_counts"] = _signals_sql()


_CONTEXTS = """
SELECT coalesce(r.run_id, d.doc_id) AS run_id, CASE WHEN r.full IS NOT NULL THEN 'full' ELSE 'index' END AS kind,
       coalesce(r.full, d.text) AS context, CAST(length(coalesce(r.full, d.text)) AS BIGINT) AS n_chars
FROM (SELECT conv_id AS run_id, arg_min(text, turn) FILTER (WHERE role = 'system') AS full
      FROM conversations GROUP BY conv_id) AS r
FULL JOIN documents d ON d.doc_id = r.run_id"""

ORACLE["context_choice"] = f"SELECT run_id, kind, n_chars FROM ({_CONTEXTS}) AS c"

_QA = """
SELECT conv_id AS run_id, turn AS query_id, text AS query, answer FROM (
  SELECT *, first(CASE WHEN role = 'assistant' THEN text END IGNORE NULLS) OVER (
    PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS answer
  FROM conversations) AS t WHERE role = 'user'"""


def _arm_prompts_sql() -> str:
    from cartograph.functions import prompts as PR
    pre, post = PR.ENHANCED_SYSTEM.split("{context}")
    return f"""
SELECT q.run_id, q.query_id, a.arm,
       CASE WHEN a.arm = 'baseline' THEN {D.lit(PR.BASELINE_SYSTEM)}
            ELSE {D.lit(pre)} || coalesce(c.context, '') || {D.lit(post)} END AS system,
       q.query AS prompt
FROM ({_QA}) AS q LEFT JOIN ({_CONTEXTS}) AS c ON q.run_id = c.run_id,
     (SELECT unnest(['baseline', 'enhanced']) AS arm) AS a"""


ORACLE["arm_prompts"] = _arm_prompts_sql()


def _fill_sql(template: str, values: dict[str, str]) -> str:
    import re
    parts, pos = [], 0
    for m in re.finditer(r"\{([a-z_]+)\}", template):
        if m.group(1) in values:
            parts += [D.lit(template[pos:m.start()]), values[m.group(1)]]
            pos = m.end()
    parts.append(D.lit(template[pos:]))
    return "(" + " || ".join(parts) + ")"


def _judge_prompt_expr(baseline: str, enhanced: str) -> str:
    from cartograph.functions import prompts as PR
    facts = ("array_to_string(list_transform(list_filter(string_split(coalesce(q.answer, ''), "
             "chr(10)), lambda x: x <> ''), lambda x: '- ' || x), chr(10))")
    return _fill_sql(PR.JUDGE_TEMPLATE, {"query": "q.query", "key_facts_formatted": facts, "baseline": baseline, "enhanced": enhanced})


def _judge_prompts_sql() -> str:
    from cartograph.functions import prompts as PR
    return f"""
SELECT q.run_id, q.query_id, {D.lit(PR.JUDGE_SYSTEM)} AS system,
       {_judge_prompt_expr("coalesce(q.answer, '')", "coalesce(c.context, '')")} AS prompt
FROM ({_QA}) AS q LEFT JOIN ({_CONTEXTS}) AS c ON q.run_id = c.run_id"""


ORACLE["judge_prompts"] = _judge_prompts_sql()


def _querygen_sql() -> str:
    from cartograph.sources import fixtures as FX
    raw = ", ".join(f"{expr} AS {name}" for name, expr in FX.QUERYGEN_COLUMNS.items())
    st = D.staged(f"SELECT {raw} FROM events", [
        [f"{D.unfence('raw')} AS s1"],
        [f"{D.bracket_slice('s1', '[', ']')} AS s2"],
        [f"CASE WHEN {D.has_brackets('s1', '[', ']')} AND json_valid(s2) AND json_type(s2) = 'ARRAY' "
         f"AND {D.single_value('s2')} THEN from_json(s2, "
         "'[{\"query\": \"VARCHAR\", \"category\": \"VARCHAR\", \"key_facts\": [\"VARCHAR\"]}]') END AS items"],
    ])
    return f"""
SELECT reply_id, run_id, CAST(item_pos AS INTEGER) AS item_pos, it.query AS query,
       coalesce(it.category, 'general') AS category, array_to_string(it.key_facts, ' | ') AS key_facts_text,
       CAST(len(it.key_facts) AS INTEGER) AS n_key_facts
FROM (SELECT reply_id, run_id, unnest(items) AS it, unnest(range(len(items))) AS item_pos
      FROM ({st}) AS q WHERE items IS NOT NULL) AS u"""


ORACLE["generated_queries_parse"] = _querygen_sql()

ORACLE["batch_infer"] = f"""
SELECT run_id, query_id,
       CASE WHEN length(prompt) % 7 = 0 THEN NULL ELSE 'len=' || CAST(length(prompt) AS VARCHAR) END AS response,
       CASE WHEN length(prompt) % 7 = 0 THEN 'ValueError: refused' END AS error
FROM ({_judge_prompts_sql()}) AS p"""

ORACLE["map_unfence"] = f"""
SELECT site, variant, {D.strip_code_fence('doc')} AS doc
FROM ({_variants_sql()}) AS v"""


def _rewrite_sql() -> str:
    from cartograph.functions import prompts as PR
    return (f"SELECT site, {_fill_sql(PR.REWRITE_TEMPLATE, {'basic_map': 'doc', 'site_name': 'site_name'})} AS prompt "
            f"FROM ({ORACLE['sitemap_documents']}) AS d")


ORACLE["rewrite_prompts"] = _rewrite_sql()


def _querygen_prompts_sql() -> str:
    from cartograph.functions import prompts as PR
    filled = _fill_sql(PR.QUERY_GEN_TEMPLATE, {'llms_content': "coalesce(text, '')"})
    return f"SELECT doc_id AS run_id, {filled} AS prompt FROM documents"


ORACLE["query_gen_prompts"] = _querygen_prompts_sql()


ORACLE["query_limit"] = f"""
SELECT run_id, query_id, query FROM ({_QA}) AS q
QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY query_id) <= 3"""

ORACLE["sitemap_documents_full"] = ORACLE["sitemap_documents"]

# T1 on the derived tree visits pages in page_id order: same documents.
ORACLE["bfs_sitemap_documents"] = _documents_sql(DEFAULT_MAX_PAGES)

ORACLE["seed_prefix_scope"] = f"""
WITH ix AS ({_index_sql()}),
seeds AS (SELECT DISTINCT site, site AS base_url FROM ix WHERE site <> '')
SELECT s.site,
       count(p.url) AS n_prefix,
       count(p.url) FILTER (WHERE {D.site_of('p.url')} = {D.site_of('s.base_url')}) AS n_authority
FROM seeds s LEFT JOIN (SELECT url FROM ix) p ON starts_with(p.url, s.base_url)
GROUP BY s.site"""


def _report_sql() -> str:
    from cartograph.functions import jsonparse as J
    from cartograph.operators import report as R
    one = lambda x: f"printf('%.1f', {x})"
    signed = lambda x: f"CASE WHEN {x} > 0 THEN '+' ELSE '' END || {one(x)}"
    num = lambda x: f"CASE WHEN {x} = floor({x}) THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) ELSE CAST({x} AS VARCHAR) END"
    n_head = len(R.SUMMARY_HEADER)
    rank = "CASE criterion " + " ".join(f"WHEN {D.lit(c)} THEN {k}" for k, c in enumerate(J.CRITERIA)) + " END"
    tail = [
        f"{D.lit('| ' + R.OVERALL_LABEL + ' | **')} || {one('overall_baseline')} || '** | **' || {one('overall_enhanced')} "
        f"|| '** | **' || {signed('overall_delta')} || '** |'",
        "''",
        f"CASE WHEN improvement_pct IS NOT NULL THEN {D.lit(R.IMPROVEMENT_PREFIX)} || printf('%+.0f', improvement_pct) "
        f"|| {D.lit(R.IMPROVEMENT_SUFFIX)} END",
        "''",
    ]
    rows = []
    for c in J.CRITERIA:
        d = f"(e_{c} - b_{c})"
        rows.append(f"'| {c.capitalize()} | ' || {num(f'b_{c}')} || ' | ' || {num(f'e_{c}')} || ' | ' "
                    f"|| CASE WHEN {d} > 0 THEN '+' ELSE '' END || {num(d)} || ' |'")
    note = lambda arm, label: f"CASE WHEN coalesce({arm}_notes, '') <> '' THEN {D.lit(label)} || {arm}_notes END"
    block = [
        f"{D.lit(R.QUERY_PREFIX)} || CAST(query_no AS VARCHAR) || ': ' || query",
        f"{D.lit(R.CATEGORY_PREFIX)} || category || {D.lit(R.CATEGORY_SUFFIX)}", "''",
        *[D.lit(x) for x in R.QUERY_TABLE_HEADER], *rows, "''",
        note("b", R.BASELINE_NOTE), note("e", R.ENHANCED_NOTE), "''",
        *[D.lit(x) for x in R.DETAILS_OPEN], "''",
        D.lit(R.BASELINE_LABEL), "'> ' || substr(baseline, 1, 500) || '...'", "''",
        D.lit(R.ENHANCED_LABEL), "'> ' || substr(enhanced, 1, 500) || '...'", "''",
        D.lit(R.DETAILS_CLOSE), "''",
    ]
    lines = lambda xs: f"unnest([{', '.join(xs)}]) AS line, unnest(range({len(xs)})) AS k"
    return f"""
WITH ov AS ({ORACLE['overall_improvement']}),
cm AS ({ORACLE['criterion_means']}),
ok AS (SELECT * FROM ({_judge_sql()}) AS j WHERE reason = 'ok'),
q AS (
  SELECT ok.*, 'What did event ' || CAST(e.event_id AS VARCHAR) || ' record?' AS query, e.props AS baseline,
         'Event of type ' || e.event_type || ' with value ' || CAST(e.value AS VARCHAR) AS enhanced,
         row_number() OVER (PARTITION BY ok.run_id ORDER BY ok.query_id) AS query_no
  FROM ok JOIN events e ON e.user_id = ok.run_id AND e.event_id = ok.query_id)
SELECT run_id, 1 AS block, CAST(0 AS BIGINT) AS query_no, CAST(k AS INTEGER) AS line_no, line
FROM (SELECT run_id, {lines([D.lit(x) for x in R.SUMMARY_HEADER])} FROM ov) AS h
UNION ALL
SELECT run_id, 1, 0, CAST({rank} + {n_head} AS INTEGER),
       '| ' || upper(substr(criterion, 1, 1)) || substr(criterion, 2) || ' | ' || {one('baseline_mean')} || ' | '
       || {one('enhanced_mean')} || ' | ' || {signed('delta')} || ' |' FROM cm
UNION ALL
SELECT run_id, 1, 0, CAST(k + {n_head + len(J.CRITERIA)} AS INTEGER), line FROM (SELECT run_id, {lines(tail)} FROM ov) AS t WHERE line IS NOT NULL
UNION ALL
SELECT run_id, 2, query_no, CAST(k AS INTEGER), line FROM (SELECT run_id, query_no, {lines(block)} FROM q) AS b WHERE line IS NOT NULL"""


ORACLE["report_lines"] = _report_sql()


def _experiment_sql() -> str:
    from cartograph.functions import prompts as PR
    pre, post = PR.ENHANCED_SYSTEM.split("{context}")
    answer = lambda n: f"'Answer of ' || CAST({n} AS VARCHAR) || ' characters.'"
    cells = lambda step: " + ".join(f"(1 + (n + {step * k + step}) % 10)" for k in range(4))
    return f"""
WITH q AS (
  SELECT qa.*, length(qa.query) + {len(PR.BASELINE_SYSTEM)} AS nb,
         length(qa.query) + {len(pre) + len(post)} + length(coalesce(c.context, '')) AS ne
  FROM ({_QA}) AS qa LEFT JOIN ({_CONTEXTS}) AS c ON qa.run_id = c.run_id),
j AS (SELECT q.run_id, length({_judge_prompt_expr(answer('q.nb'), answer('q.ne'))}) AS n FROM q WHERE nb % 11 <> 0 AND ne % 11 <> 0),
t AS (SELECT run_id, count(*) AS n_queries, sum({cells(1)}) AS tb, sum({cells(3)}) AS te
      FROM j WHERE n % 13 <> 0 AND n % 7 <> 0 GROUP BY run_id)
SELECT run_id, n_queries, b AS overall_baseline, e AS overall_enhanced, e - b AS overall_delta, (e - b) / b * 100 AS improvement_pct
FROM (SELECT run_id, n_queries, tb / (n_queries * 4) AS b, te / (n_queries * 4) AS e FROM t) AS m"""


ORACLE["experiment_end_to_end"] = _experiment_sql()

ORACLE["rewrite_end_to_end"] = f"""
WITH d AS (SELECT s.site, s.n_pages, s.doc, length(p.prompt) AS n FROM ({ORACLE['sitemap_documents']}) AS s
           JOIN ({ORACLE['rewrite_prompts']}) AS p ON p.site = s.site),
m AS (SELECT *, CASE WHEN n % 7 <> 0 AND n % 5 = 0 AND contains(doc, '](http://') THEN 1 ELSE 0 END AS moved FROM d)
SELECT site, CASE WHEN n % 7 = 0 THEN 'basic' ELSE 'rewritten' END AS source,
       CAST(moved AS BIGINT) AS n_lost, CAST(moved AS BIGINT) AS n_invented, n_pages - moved AS n_kept FROM m"""

ORACLE["questions_end_to_end"] = f"""
WITH p AS (SELECT run_id, length(prompt) AS n FROM ({ORACLE['query_gen_prompts']}) AS q)
SELECT run_id, CAST(NULL AS INTEGER) AS item_pos, NULL AS query, NULL AS category, NULL AS key_facts_text,
       CASE WHEN n % 7 = 0 THEN 'model_error' ELSE 'no_array' END AS reason FROM p WHERE n % 7 = 0 OR n % 5 = 0
UNION ALL
SELECT run_id, 0, 'What is ' || CAST(n AS VARCHAR) || '?', 'size', CAST(n AS VARCHAR), 'ok' FROM p WHERE n % 7 <> 0 AND n % 5 <> 0
UNION ALL
SELECT run_id, 1, 'Anything else?', 'general', NULL, 'no_key_facts' FROM p WHERE n % 7 <> 0 AND n % 5 <> 0"""


ORACLE["map_merged_duplicates"] = f"""
WITH lt AS ({_line_table_sql()}),
l AS (SELECT *, {D.url_key('url')} AS url_key FROM lt WHERE kind = 'link'),
f AS (SELECT site, variant, url_key, min(line_no) AS line_no, arg_min(description, line_no) FILTER (WHERE description <> '') AS said
      FROM l GROUP BY site, variant, url_key)
SELECT l.site, l.variant, l.line_no, l.kind, l.url, coalesce(f.said, l.description) AS description
FROM l JOIN f ON f.site = l.site AND f.variant = l.variant AND f.line_no = l.line_no
UNION ALL SELECT site, variant, line_no, kind, url, description FROM lt WHERE kind <> 'link'"""

ORACLE["map_similar_titles"] = f"""
WITH d AS ({ORACLE['sitemap_documents']}),
c AS (SELECT site, unnest(string_split(doc, {NL})) AS line, CAST(unnest(range(1, len(string_split(doc, {NL})) + 1)) AS INTEGER) AS line_no FROM d),
t AS (SELECT site, line_no, list_distinct(regexp_extract_all(lower(regexp_extract(line, '^- \\[(.*)\\]\\(http', 1)), '[\\p{{L}}\\p{{N}}]+')) AS w
      FROM c WHERE starts_with(line, '- ['))
SELECT a.site, a.line_no AS line_a, b.line_no AS line_b, len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) AS similarity
FROM t a JOIN t b ON a.site = b.site AND a.line_no < b.line_no
WHERE len(a.w) > 0 AND len(b.w) > 0 AND len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) >= 0.8"""

_TITLE_WORDS = "list_sort(list_distinct(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+')))"
_SIMILARITY = "len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w)))"

ORACLE["map_title_classes"] = f"""
WITH d AS ({ORACLE['sitemap_documents']}),
c AS (SELECT site, unnest(string_split(doc, {NL})) AS line, CAST(unnest(range(1, len(string_split(doc, {NL})) + 1)) AS INTEGER) AS line_no FROM d),
t AS (SELECT site, line_no, {_TITLE_WORDS.format("regexp_extract(line, '^- \\[(.*)\\]\\(http', 1)")} AS w FROM c WHERE starts_with(line, '- [')),
m AS (SELECT *, min(line_no) OVER (PARTITION BY site, w) AS class_line FROM t WHERE len(w) > 0),
r AS (SELECT * FROM m WHERE line_no = class_line)
SELECT site, line_no, class_line, CAST(NULL AS INTEGER) AS similar_class, CAST(NULL AS DOUBLE) AS similarity FROM m
UNION ALL
SELECT a.site, CAST(NULL AS INTEGER), a.line_no, b.line_no, {_SIMILARITY} FROM r a JOIN r b ON a.site = b.site AND a.line_no < b.line_no
WHERE {_SIMILARITY} >= 0.8"""

# Classes of duplicates: labels spread along equal URL keys and similar titles until nothing changes.
ORACLE["map_merged_similar"] = f"""
WITH RECURSIVE lt AS MATERIALIZED ({_line_table_sql()}),
l AS MATERIALIZED (SELECT *, {D.url_key('url')} AS url_key, {_TITLE_WORDS.format('title')} AS w FROM lt WHERE kind = 'link'),
e AS MATERIALIZED (SELECT a.site, a.variant, a.line_no AS a, b.line_no AS b FROM l a
  JOIN l b ON a.site = b.site AND a.variant = b.variant AND a.line_no <> b.line_no
  WHERE a.url_key = b.url_key OR (len(a.w) > 0 AND len(b.w) > 0 AND {_SIMILARITY} >= 0.8)),
reach AS (SELECT site, variant, line_no, line_no AS root FROM l
  UNION SELECT r.site, r.variant, e.b, r.root FROM reach r JOIN e ON e.site = r.site AND e.variant = r.variant AND e.a = r.line_no
        WHERE r.root < e.b),
c AS (SELECT site, variant, line_no, min(root) AS root FROM reach GROUP BY ALL),
s AS (SELECT l.site, l.variant, c.root, arg_min(l.description, l.line_no) FILTER (WHERE l.description <> '') AS said
      FROM l JOIN c ON c.site = l.site AND c.variant = l.variant AND c.line_no = l.line_no GROUP BY ALL)
SELECT l.site, l.variant, l.line_no, l.kind, l.url, coalesce(s.said, l.description) AS description
FROM l JOIN s ON s.site = l.site AND s.variant = l.variant AND s.root = l.line_no
UNION ALL SELECT site, variant, line_no, kind, url, description FROM lt WHERE kind <> 'link'"""

ORACLE["dropped_pages"] = f"""
SELECT page_id, url, CASE WHEN title_state NOT IN ('ok', 'absent') THEN 'title_' || title_state ELSE 'no_site' END AS reason
FROM ({_index_sql()}) AS ix WHERE title_state NOT IN ('ok', 'absent') OR site = ''"""

_FAULTY_ONCE = """SELECT page_id, url, CASE WHEN page_id % 5 = 1 THEN '<html><title></title></html>' ELSE html END AS html,
       page_id % 3 <> 0 AS fetched FROM pages"""
_FAULTY = f"""SELECT * FROM ({_FAULTY_ONCE}) AS a
UNION ALL SELECT page_id + 1000000000000 AS page_id, url, html, fetched FROM ({_FAULTY_ONCE}) AS b WHERE page_id % 7 = 2"""
_FAULTY_STATES = D.staged(
    f"SELECT *, row_number() OVER (PARTITION BY url, fetched ORDER BY page_id) AS nth FROM ({_FAULTY}) AS f",
    [[f"{D.clean_html('html')} AS clean", f"{D.site_of('url')} AS site"], [f"{D.title_state('clean')} AS title_state"]])
ORACLE["row_accounts"] = f"""
SELECT 'pages' AS step, CASE WHEN NOT fetched THEN 'failed' WHEN url IS NULL THEN 'no_url' WHEN nth > 1 THEN 'duplicate_url'
       WHEN title_state NOT IN ('ok', 'absent') THEN 'title_' || title_state WHEN site = '' THEN 'no_site' END AS reason,
       count(*) AS n_rows FROM ({_FAULTY_STATES}) AS s GROUP BY ALL
UNION ALL SELECT 'replies' AS step, nullif(reason, 'ok') AS reason, count(*) AS n_rows FROM ({_judge_sql()}) AS q GROUP BY ALL"""

ORACLE["pages_with_status"] = """
SELECT min(page_id) AS page_id, url FROM pages WHERE page_id % 3 <> 0 GROUP BY url"""

ORACLE["io_site_maps"] = f"""
SELECT site, doc, CAST(length(doc) AS BIGINT) AS n_chars FROM ({ORACLE['sitemap_documents']}) AS d"""

ORACLE["io_query_set"] = """
SELECT row_number() OVER (ORDER BY item_id) - 1 AS query_id, text AS query, 'general' AS category, 'item ' || CAST(item_id AS VARCHAR) AS facts
FROM benchmark"""

ORACLE["io_reports"] = f"""
SELECT run_id, string_agg(line || {NL}, '' ORDER BY block, query_no, line_no) AS report FROM ({ORACLE['report_lines']}) AS r GROUP BY run_id"""
