"""Lexical response measures (K1, K2).

K1 is a containment join: a fact is covered by a response when every
distinct token of the fact occurs in the response. It never forms the
responses x facts product: a fact meets only responses that hold its two
rarest tokens, and what it has beyond them is looked up in the response's
array of tokens. A token that very many responses hold is a hot key of the
first join on the side of the responses, which adaptive execution splits.
These are lexical measures, not the judge's four scores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartograph.functions.text import col
from cartograph.session import ensure_checkpoint_dir

# --- fixed values -----------------------------------------------------------
TOKEN_PATTERN = r"[\p{L}\p{N}]+"
URL_PATTERN = r"https?://[^\t\n\x{0B}\f\r )\]>\"']+"
EMAIL_PATTERN = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
# Java form of the same matches: start only at the beginning of a run and
# never backtrack into it, so a long run without "@" is scanned once, not
# once per position (RE2 in the DuckDB twin is linear already).
EMAIL_PATTERN_JAVA = r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
# no repeated group (Java's regex engine would recurse per repetition on
# long digit runs); "1..2" counts once here
NUMBER_PATTERN = r"[0-9][0-9.,]*[0-9]|[0-9]"
MD_LINK_PATTERN = r"\[[^\[\]]*\]\(https?://[^)]*\)"  # link text without brackets: linear scan
# ---------------------------------------------------------------------------


def tokens(text) -> F.Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(col(text)), F.lit(TOKEN_PATTERN), 0))


def rare_pairs(held: DataFrame, fe: DataFrame, fact_id: str) -> DataFrame:
    """(fact_id, w1, w2, rest, n_tokens): a fact's two rarest tokens (w2 null if it has one) and the others.

    A fact with a token that no response holds is left out.
    """
    df = held.groupBy("tok").agg(F.count("*").alias("df"))
    by_rarity = fe.join(df, "tok").groupBy(fact_id, "n_tokens").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("df", "tok"))), lambda x: x["tok"]).alias("toks"))   # one fact's tokens
    return by_rarity.filter(F.size("toks") == F.col("n_tokens")).select(
        fact_id, F.col("toks")[0].alias("w1"), F.get("toks", F.lit(1)).alias("w2"),
        F.slice("toks", 3, 1 << 30).alias("rest"), "n_tokens")


def covered_facts(responses: DataFrame, facts: DataFrame, resp_id: str = "doc_id",
                  fact_id: str = "item_id") -> DataFrame:
    """(resp_id, fact_id, n_tokens) for every response that covers a fact.

    ``resp_id`` and ``fact_id`` identify a row. Responses are tokenised once;
    only tokens that some fact uses are written, the others cannot matter. A
    null text has no tokens.
    """
    spark = responses.sparkSession
    ensure_checkpoint_dir(spark)
    ft = facts.select(fact_id, tokens("text").alias("toks")).filter(F.size("toks") > 0)
    fe = ft.select(fact_id, F.size("toks").alias("n_tokens"), F.explode("toks").alias("tok"))
    held = (responses.select(resp_id, F.explode(tokens("text")).alias("tok"))
            .join(fe.select("tok").distinct(), "tok", "left_semi").checkpoint(eager=True))
    vocab = held.groupBy(resp_id).agg(F.collect_list("tok").alias("vocab"))            # bounded by one response
    pairs = rare_pairs(held, fe, fact_id).checkpoint(eager=True)        # as small as the facts; read by two joins
    # responses with a fact's rarest token, one row per pair of tokens however many facts share it
    met = held.withColumnRenamed("tok", "w1").join(pairs.select("w1", "w2").distinct(), "w1")
    both = (met.join(vocab, resp_id).filter(F.col("w2").isNull() | F.array_contains("vocab", F.col("w2")))
            .select(resp_id, "w1", "w2"))
    same = [F.col("c.w1") == F.col("p.w1"), F.col("c.w2").eqNullSafe(F.col("p.w2"))]
    candidates = both.alias("c").join(pairs.alias("p"), same).select(f"c.{resp_id}", f"p.{fact_id}", "p.n_tokens", "p.rest")
    # what a fact has beyond its two rarest tokens is looked up in the response's array
    all_held = F.forall("rest", lambda t: F.array_contains("vocab", t))
    return candidates.join(vocab, resp_id).filter(all_held).select(resp_id, fact_id, "n_tokens")


def response_coverage(responses: DataFrame, facts: DataFrame, resp_id: str = "doc_id",
                      fact_id: str = "item_id") -> DataFrame:
    """Per response: facts covered and the covered share of all facts."""
    total = facts.select(tokens("text").alias("toks")).agg(F.count_if(F.size("toks") > 0).alias("n_facts"))
    cov = covered_facts(responses, facts, resp_id, fact_id).groupBy(resp_id).agg(F.count("*").alias("n_covered"))
    covered = F.coalesce("n_covered", F.lit(0)).cast("bigint")
    return (responses.select(resp_id).join(cov, resp_id, "left").join(F.broadcast(total))    # one row
            .select(resp_id, covered.alias("n_covered"), "n_facts", F.try_divide(covered, "n_facts").alias("coverage")))


def signal_counts(responses: DataFrame, resp_id: str = "doc_id") -> DataFrame:
    """K2: concrete signals per response over the whole text."""
    def n(p):
        return F.regexp_count("text", F.lit(p)).cast("bigint")
    return responses.select(resp_id, n(URL_PATTERN).alias("n_urls"), n(EMAIL_PATTERN_JAVA).alias("n_emails"),
                            n(NUMBER_PATTERN).alias("n_numbers"), n(MD_LINK_PATTERN).alias("n_md_links"))
