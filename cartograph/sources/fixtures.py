"""Inputs derived from the driver tables, as SQL expression text.

The same expression strings run in Spark (``selectExpr``) and in DuckDB, so
both engines see identical synthetic inputs. Everything here is synthetic
filler built from real rows and is labelled so in the README.

* judge replies from ``events``: run = user_id, query = event_id, category =
  event_type; eight integer scores from arithmetic on the ids; reply shape
  chosen by ``event_id % 17`` (plain, fenced, prose around it, malformed,
  a criterion missing, a score as a string, two objects, truncated, ...).
* generated question lists from ``events`` the same way (one reply per event).
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartograph.functions.jsonparse import CRITERIA

_K = {("baseline", c): k for c, k in zip(CRITERIA, (3, 5, 7, 11))}
_K.update({("enhanced", c): k for c, k in zip(CRITERIA, (13, 17, 19, 23))})


def _score(arm: str, c: str) -> str:
    k = _K[(arm, c)]
    if arm == "baseline":
        return f"CAST(1 + (event_id * {k} + user_id) % 10 AS STRING)"
    return f"CAST(least(10, 2 + (event_id * {k} + user_id) % 10) AS STRING)"


def _obj(quote_accuracy: bool = False) -> str:
    parts = []
    for arm in ("baseline", "enhanced"):
        fields = []
        for c in CRITERIA:
            v = _score(arm, c)
            if quote_accuracy and c == "accuracy":
                fields.append(f"'\"{c}\": \"' || {v} || '\"'")
            else:
                fields.append(f"'\"{c}\": ' || {v}")
        notes = f"'\"notes\": \"' || event_type || ' {arm}\"'"
        parts.append(f"'\"{arm}\": {{' || " + " || ', ' || ".join(fields + [notes]) + " || '}'")
    return "('{' || " + " || ', ' || ".join(parts) + " || '}')"


OBJ = _obj()
NL = "chr(10)"
JUDGE_RAW_SQL = f"""CASE event_id % 17
  WHEN 0 THEN 'I am unable to evaluate these responses.'
  WHEN 1 THEN '```json' || {NL} || {OBJ} || {NL} || '```'
  WHEN 2 THEN 'Sure! Here is the evaluation:' || {NL} || {OBJ}
  WHEN 3 THEN replace({OBJ}, '"specificity"', '"specifity"')
  WHEN 4 THEN {_obj(quote_accuracy=True)}
  WHEN 5 THEN {OBJ} || ' Second opinion: ' || {OBJ}
  WHEN 6 THEN substr({OBJ}, 1, 60)
  WHEN 7 THEN {OBJ} || ' Overall the enhanced answer is better.'
  WHEN 8 THEN replace({OBJ}, ' baseline"', ' baseline {{with braces}}"')
  WHEN 9 THEN replace({OBJ}, '"', '''')
  WHEN 10 THEN '```' || {NL} || {OBJ} || {NL} || '```'
  WHEN 11 THEN replace({OBJ}, ', "completeness"', '.5, "completeness"')
  ELSE {OBJ} END"""

JUDGE_COLUMNS = {
    "run_id": "user_id",
    "query_id": "event_id",
    "category": "CASE WHEN event_id % 9 = 0 THEN NULL ELSE event_type END",
    "raw": JUDGE_RAW_SQL,
}

def judge_raw(events: DataFrame) -> DataFrame:
    return events.selectExpr(*[f"{expr} AS {name}" for name, expr in JUDGE_COLUMNS.items()])


# Generated-question replies, one per event (bounded size).
_ITEM1 = ("'{\"query\": \"What happened in ' || event_type || ' ' || CAST(event_id AS STRING) || '?\", "
          "\"category\": \"' || event_type || '\", \"key_facts\": [\"' || event_type || '\", \"id ' "
          "|| CAST(event_id AS STRING) || '\"]}'")
_ITEM2 = ("'{\"query\": \"Who is user ' || CAST(user_id AS STRING) || '?\", \"key_facts\": [\"user ' "
          "|| CAST(user_id AS STRING) || '\"]}'")
QUERYGEN_RAW_SQL = f"""CASE event_id % 5
  WHEN 0 THEN '```json' || {NL} || '[' || {_ITEM1} || ', ' || {_ITEM2} || ']' || {NL} || '```'
  WHEN 1 THEN 'Here are the questions: [' || {_ITEM1} || '] Enjoy.'
  WHEN 2 THEN '[' || {_ITEM1} || ', ]'
  WHEN 3 THEN 'No questions today.'
  ELSE '[' || {_ITEM1} || ', ' || {_ITEM2} || ']' END"""
QUERYGEN_COLUMNS = {"reply_id": "event_id", "run_id": "user_id", "raw": QUERYGEN_RAW_SQL}


def querygen_raw(events: DataFrame) -> DataFrame:
    return events.selectExpr(*[f"{expr} AS {name}" for name, expr in QUERYGEN_COLUMNS.items()])


def derived_tree_links(ranked_pages: DataFrame) -> DataFrame:
    """Synthetic link table for tests: in each site (pages r = 0, 1, ... by
    page_id), page r links to 2r+1, 2r+2, r-1 and r, in that order, where
    those pages exist. FIFO order is then r order.
    """
    src = ranked_pages.select("site", F.col("url").alias("src_url"), "r")
    edges = src.select("site", "src_url", F.posexplode(F.array(
        2 * F.col("r") + 1, 2 * F.col("r") + 2, F.col("r") - 1, F.col("r"))).alias("pos", "t"))
    dst = ranked_pages.select("site", F.col("r").alias("t"), F.col("url").alias("dst_url"))
    return edges.join(dst, ["site", "t"]).select("src_url", "pos", "dst_url")


def planted_links(ranked_pages: DataFrame, pages: DataFrame) -> DataFrame:
    """Synthetic captures (page_id, url, html, status): links planted into the HTML of the captured pages.

    In each site (pages r = 0, 1, ... by page_id), page r links to itself, its
    parent (r-1)/2, a file with an excluded suffix, a missing page, 2r+1 and
    2r+2, in that order, where those pages exist. Fetching page r failed where
    r modulo 7 is 5.
    """
    url_of = ranked_pages.select("site", F.col("r").alias("t"), F.col("url").alias("dst"))
    wanted = ranked_pages.select("site", "r", F.posexplode(F.array(
        F.col("r"), F.floor((F.col("r") - 1) / 2), 2 * F.col("r") + 1, 2 * F.col("r") + 2)).alias("pos", "t"))
    anchor = F.concat(F.lit('<a href="'), F.replace(F.replace("dst", F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;")),
                      F.lit('">x</a>'))
    extra = F.concat(F.lit('<a href="'), F.col("site"), F.lit('/x.pdf">x</a><a href="'), F.col("site"), F.lit('/missing/page">x</a>'))
    anchors = (wanted.join(url_of, ["site", "t"]).groupBy("site", "r")
               .agg(F.array_sort(F.collect_list(F.struct("pos", anchor.alias("a")))).alias("all")))
    near, far = (F.array_join(F.transform(F.filter("all", part), lambda x: x["a"]), "")
                 for part in (lambda x: x["pos"] < 2, lambda x: x["pos"] >= 2))
    planted = ranked_pages.join(anchors, ["site", "r"]).select(
        "page_id", F.concat(F.lit("<p>"), near, extra, far, F.lit("</p>")).alias("links"),
        F.when(F.col("r") % 7 == 5, 404).otherwise(200).alias("status"))
    return pages.join(planted, "page_id").select("page_id", "url", F.concat("links", "html").alias("html"), "status")


def faulty_captures(pages: DataFrame) -> DataFrame:
    """Synthetic captures (page_id, url, html, status) with planted faults.

    A third of the fetches failed, a fifth of the pages have an empty title, a
    seventh were captured a second time under a later id.
    """
    html = F.when(F.col("page_id") % 5 == 1, "<html><title></title></html>").otherwise(F.col("html"))
    once = pages.select("page_id", "url", html.alias("html"), F.when(F.col("page_id") % 3 == 0, 404).otherwise(200).alias("status"))
    return once.unionByName(once.filter("page_id % 7 = 2").withColumn("page_id", F.col("page_id") + 1_000_000_000_000))


# Planted faults on generated maps (FIXTURES.md C), all string operations.
def planted_variants(docs: DataFrame) -> DataFrame:
    """(site, variant, doc): the map itself plus one copy per planted fault."""
    d, base = F.col("doc"), F.col("base_url")
    nl = F.lit("\n")

    def first_replace(s, old, new):
        pos = F.instr(s, old)
        new = F.lit(new) if isinstance(new, str) else new
        return F.when(pos > 0, F.concat(F.substring(s, F.lit(1), pos - 1), new,
                                        F.substring(s, pos + len(old), F.lit(1 << 30)))).otherwise(s)

    link_start = F.instr(d, "\n- [")
    after = F.substring(d, link_start + 1, F.lit(1 << 30))
    first_link = F.substring_index(after, "\n", 1)
    dropped = F.when(link_start > 0, F.concat(F.substring(d, F.lit(1), link_start),
                                               F.substring(after, F.length(first_link) + 2, F.lit(1 << 30)))).otherwise(d)
    described = F.regexp_replace(d, r"(?m)^(- \[.*\]\(https?://.*\))$", "$1: Short page description")
    long_desc = F.regexp_replace(d, r"(?m)^(- \[.*\]\(https?://.*\))$",
                                 "$1: " + " ".join(["word"] * 16))
    optional = F.concat(F.lit("## Optional\n\n- [More pages]("), base, F.lit("/more)\n\n"))
    variants = [
        ("basic", d),
        ("fenced", F.concat(F.lit("```markdown\n"), d, F.lit("```"))),
        ("json_metadata", F.concat(d, F.lit('{"generated_by": "model", "pages": '),
                                   F.length(d).cast("string"), F.lit("}\n"))),
        ("deep_heading", first_replace(d, "\n## ", "\n### ")),
        ("link_dropped", dropped),
        ("link_invented", F.concat(d, F.lit("- [Invented page]("), base, F.lit("/invented-page)\n"))),
        ("duplicate", F.concat(d, first_link, nl)),
        ("described", described),
        ("long_description", long_desc),
        ("with_optional", F.concat(described, optional)),
        ("optional_not_last", first_replace(described, "\n## ", F.concat(
            F.lit("\n## Optional\n\n- [More pages]("), base, F.lit("/more)\n\n## ")))),
    ]
    # a row holds one variant, never a site's eleven at once; variants of one site are dealt to different tasks
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = docs.select("site", "base_url", "doc", F.explode(F.array(*[F.lit(name) for name, _ in variants])).alias("variant"))
    planted = None
    for name, expr in variants:
        case = F.col("variant") == name
        planted = F.when(case, expr) if planted is None else planted.when(case, expr)
    return each.repartition(n, "site", "variant").select("site", "base_url", "variant", planted.alias("doc"))


# Deterministic stand-ins for a model; each can be written in SQL as well.
def length_model(prompts, systems=None):
    """Deterministic stand-in for a model (tests and the registered query):
    answers with the prompt length and refuses prompts whose length is a
    multiple of 7."""
    out = []
    for p in prompts:
        if len(p) % 7 == 0:
            raise ValueError("refused")
        out.append(f"len={len(p)}")
    return out


def answer_model(prompts, systems=None):
    """Says how long prompt and system text are; refuses multiples of 11."""
    sizes = [len(p) + len(s) for p, s in zip(prompts, systems)]
    if any(n % 11 == 0 for n in sizes):
        raise ValueError("refused")
    return [f"Answer of {n} characters." for n in sizes]


def judge_model(prompts, systems=None):
    """Scores from the prompt's length; refuses multiples of 13, gives no verdict on multiples of 7."""
    if any(len(p) % 13 == 0 for p in prompts):
        raise ValueError("refused")
    out = []
    for n in map(len, prompts):
        arms = {a: {c: 1 + (n + step * k + step) % 10 for k, c in enumerate(CRITERIA)} for a, step in (("baseline", 1), ("enhanced", 3))}
        out.append("No verdict." if n % 7 == 0 else "Here you are:\n```json\n" + json.dumps(arms) + "\n```")
    return out


def rewrite_model(prompts, systems=None):
    """Returns the map in a code fence, its first http link turned to https on multiples of 5; refuses multiples of 7."""
    if any(len(p) % 7 == 0 for p in prompts):
        raise ValueError("refused")
    out = []
    for p in prompts:
        doc = p.split("Here's the raw site map to enhance:\n\n", 1)[1]
        out.append("```markdown\n" + (doc.replace("](http://", "](https://", 1) if len(p) % 5 == 0 else doc) + "```")
    return out


def question_model(prompts, systems=None):
    """Two questions about the prompt's length; no list on multiples of 5; refuses multiples of 7."""
    if any(len(p) % 7 == 0 for p in prompts):
        raise ValueError("refused")
    return ["No questions." if n % 5 == 0 else json.dumps([
        {"query": f"What is {n}?", "category": "size", "key_facts": [str(n)]}, {"query": "Anything else?"}]) for n in map(len, prompts)]
