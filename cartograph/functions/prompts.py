"""Prompt construction as column expressions.

Templates are parameters; the defaults below are the texts the reference
sends, kept verbatim because answers and scores depend on them.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

# --- fixed values -----------------------------------------------------------
BASELINE_SYSTEM = (
    "You are a helpful AI assistant answering questions about universities and business schools. "
    "Answer based on your general knowledge. If you're unsure about specific details, say so."
)
ENHANCED_SYSTEM = (
    "You are a helpful AI assistant answering questions about universities and business schools. "
    "You have been provided with the following structured reference about the institution. "
    "Use it to give accurate, specific, and actionable answers.\n\n"
    "--- REFERENCE ---\n{context}\n--- END REFERENCE ---"
)
JUDGE_SYSTEM = "You are a rigorous, impartial evaluator. Return only valid JSON. Be strict in scoring."
JUDGE_TEMPLATE = """You are an expert evaluator assessing AI assistant responses about a university/business school.

A user asked: "{query}"

Here are the key facts that a good answer should include:
{key_facts_formatted}

---

**Response A (Baseline — no structured context provided):**
{baseline}

---

**Response B (Enhanced — llms.txt structured context provided):**
{enhanced}

---

Score EACH response on a scale of 1-10 for each criterion:
1. **Accuracy** — Are the stated facts correct? No hallucinations?
2. **Completeness** — How many of the key facts are covered?
3. **Specificity** — Does it give concrete details (program names, URLs, features) vs. vague generalities?
4. **Actionability** — Does it help the user take a next step (links, contact info, clear recommendations)?

Return ONLY valid JSON with this exact structure:
{
  "baseline": {"accuracy": N, "completeness": N, "specificity": N, "actionability": N, "notes": "brief explanation"},
  "enhanced": {"accuracy": N, "completeness": N, "specificity": N, "actionability": N, "notes": "brief explanation"}
}"""
QUERY_GEN_SYSTEM = "You are a helpful assistant that returns only valid JSON."
QUERY_GEN_TEMPLATE = """Below is the contents of an llms.txt file for a website. Generate 8 realistic test queries
that a prospective student, employer, or researcher might ask an AI assistant about this organization.

For each query, also list 3-5 key facts from the llms.txt that a good answer should include.

Return ONLY valid JSON — an array of objects with keys: "query", "category", "key_facts" (array of strings).

llms.txt content:
---
{llms_content}
---"""
REWRITE_TEMPLATE = """You are generating an llms.txt file following the official spec (llmstxt.org).

Given this raw site map of {site_name}, produce a spec-compliant llms.txt file.

STRICT FORMAT RULES — follow these exactly:
1. Line 1: # {site_name}
2. A blank line, then a single blockquote (>) with a 1-2 sentence summary of the site
3. Optionally, 1-2 plain paragraphs of additional context (NO headings here)
4. Then ## sections grouping related pages. Only use ## headings (H2), never ### or deeper
5. Inside each ## section: a markdown list where each item is:
   - [Page Title](https://full-url): Brief description of what this page contains
6. Include a ## Optional section at the end for lower-priority pages
7. Output ONLY the raw markdown. No code fences, no ```markdown blocks, no JSON metadata

CONTENT RULES:
- Preserve ALL original URLs exactly as given
- Group related pages logically (programs, student life, research, about, etc.)
- Write concise descriptions (under 15 words each) after the colon
- Merge duplicate or near-duplicate entries
- Put the most important pages first within each section

Here's the raw site map to enhance:

{basic_map}"""
ARM_NAMES = ["baseline", "enhanced"]
# ---------------------------------------------------------------------------

_PLACEHOLDER = re.compile(r"\{([a-z_]+)\}")


def fill(template: str, **values) -> Column:
    """Substitute ``{name}`` placeholders with columns; other text is literal."""
    parts, pos = [], 0
    for m in _PLACEHOLDER.finditer(template):
        if m.group(1) not in values:
            continue
        parts.append(F.lit(template[pos:m.start()]))
        parts.append(col(values[m.group(1)]))
        pos = m.end()
    parts.append(F.lit(template[pos:]))
    return F.concat(*parts)


def arm_system(arm, context) -> Column:
    """System text per arm; the enhanced arm carries the context."""
    return F.when(col(arm) == "baseline", F.lit(BASELINE_SYSTEM)).otherwise(fill(ENHANCED_SYSTEM, context=context))


def facts_bullets(facts) -> Column:
    return F.array_join(F.transform(col(facts), lambda x: F.concat(F.lit("- "), x)), "\n")


def judge_prompt(query, facts, baseline, enhanced) -> Column:
    """P16."""
    return fill(JUDGE_TEMPLATE, query=query, key_facts_formatted=facts_bullets(facts),
                baseline=baseline, enhanced=enhanced)


def query_gen_prompt(doc) -> Column:
    """P17 (questions from the index document)."""
    return fill(QUERY_GEN_TEMPLATE, llms_content=doc)


def rewrite_prompt(basic_map, site_name) -> Column:
    """P17 (site-map rewrite)."""
    return fill(REWRITE_TEMPLATE, basic_map=basic_map, site_name=site_name)
