"""Site-map document checks (C1-C9, J6): the rewrite step's format rules as data rules.

A document becomes a line table (C1); every rule is then an aggregate over
lines of one document, so documents are checked in parallel and no document
is ever compared with another one pairwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartograph.functions import text as T
from cartograph.operators.carry import BIN, carry_last
from cartograph.session import ensure_checkpoint_dir

# --- fixed values -----------------------------------------------------------
LINK_PATTERN = r"^- \[(.*)\]\((https?://.*?)\)(?:: (.*))?\z"    # a URL may hold brackets: up to the ")" before the end or ": "
MAX_DESCRIPTION_WORDS = 15          # descriptions must stay under this
OPTIONAL_SECTION = "Optional"
LINE_KINDS = [  # checked in this order
    ("fence", r"^```"),
    ("h1", r"^# "),
    ("h2", r"^## "),
    ("deep", r"^#{3,} "),
    ("quote", r"^>"),
    ("json", r"^[{\[]"),
    ("link", LINK_PATTERN),
    ("bullet", r"^[-*+] "),
]
# ---------------------------------------------------------------------------
NON_WS = f"[^{T.PY_WS_CLASS[1:-1]}]+"


def line_kind(line) -> F.Column:
    line = T.col(line)
    expr = None
    for kind, pat in LINE_KINDS:
        expr = (F.when(line.rlike(pat), F.lit(kind)) if expr is None
                else expr.when(line.rlike(pat), F.lit(kind)))
    return expr.when(T.py_strip(line) == "", F.lit("blank")).otherwise(F.lit("text"))


def word_count(c) -> F.Column:
    return F.size(F.regexp_extract_all(T.col(c), F.lit(NON_WS), 0))


def _typed(lines: DataFrame, keys: list[str]) -> DataFrame:
    is_link = F.col("kind") == "link"
    return lines.select(
        *keys, "line_no", "line", "kind", "section",
        F.when(is_link, F.regexp_extract("line", LINK_PATTERN, 1)).alias("title"),
        F.when(is_link, F.regexp_extract("line", LINK_PATTERN, 2)).alias("url"),
        F.when(is_link, F.regexp_extract("line", LINK_PATTERN, 3)).alias("description"),
    )


def lines_of_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """C1 for documents kept as rows (keys..., line_no, line): (keys..., line_no, line, kind, section, title, url, description).

    No task sees a whole document: headings reach the lines below them through
    ``carry_last``, which reads ``rows`` twice.
    """
    lines = rows.select(*keys, "line_no", "line").withColumn("kind", line_kind("line"))
    heading = F.when(F.col("kind") == "h2", T.py_strip(F.substring("line", 4, 1 << 30)))
    return _typed(carry_last(lines, keys, "line_no", {"section": heading}), keys)


def line_table(docs: DataFrame, keys: list[str]) -> DataFrame:
    """C1 for documents kept as one string ``doc``: the table of ``lines_of_rows``, without a shuffle.

    The array of a document's lines is cut at its headings, so every line gets
    its section where the document is read.
    """
    lines = F.col("_lines")
    headings = F.filter(F.transform(lines, lambda x, i: F.when(x.startswith("## "), i)), lambda i: i.isNotNull())
    split = docs.select(*keys, F.split("doc", "\n", -1).alias("_lines"))
    split = split.select(*keys, "_lines", F.concat(F.array(F.lit(0)), headings).alias("_at"))
    # the part before the first heading has none, even if the first line is a heading (then it is empty)
    last = F.size("_at") - 1
    parts = split.select(*keys, F.posexplode(F.transform("_at", lambda at, j: F.struct(
        at.alias("at"), F.slice(lines, at + 1, F.when(j < last, F.get("_at", j + 1)).otherwise(F.size(lines)) - at).alias("lines"))
    )).alias("_part", "_p"))
    heading = F.when(F.col("_part") > 0, T.py_strip(F.substring(F.col("_p.lines")[0], 4, 1 << 30)))
    # the heading is taken before the lines are exploded: above it, every line would carry its part's whole array
    parts = parts.select(*keys, heading.alias("section"), F.col("_p.at").alias("_at"), F.col("_p.lines").alias("_lines"))
    rows = parts.select(*keys, "section", "_at", F.posexplode("_lines").alias("_pos", "line"))
    return _typed(rows.select(*keys, "section", (F.col("_at") + F.col("_pos") + 1).alias("line_no"), "line",
                              line_kind("line").alias("kind")), keys)


def conformance(lines: DataFrame, keys: list[str], width: int = BIN) -> DataFrame:
    """C2-C6, C9 per document, plus ``ok`` when every rule holds.

    Lines are aggregated in bins of ``width`` line numbers, then a document's
    bins. Within a bin a window gives the kind of the line above; for the first
    line, and the first that is not blank, it comes from the bins above. So no
    window spans a document's lines, and only counts leave a bin.
    """
    k = F.col("kind")
    inside = Window.partitionBy(*keys, "_bin").orderBy("line_no")
    above = F.last(F.when(k != "blank", k), ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    lines = lines.withColumn("_bin", F.floor(F.col("line_no") / width)).select(
        *keys, "_bin", "line_no", "kind", "section", "description",
        F.lag("kind").over(inside).alias("prev"), above.alias("above"))
    quote = k == "quote"
    h2_line = F.when(k == "h2", F.struct("line_no", "section"))
    intro_heading = k.isin("h1", "deep") & (F.col("line_no") > 1) & F.col("section").isNull()
    counts = {
        "n_lines": F.lit(True),
        "n_h1": k == "h1",
        "n_first_h1": (k == "h1") & (F.col("line_no") == 1),
        "n_quote_blocks": quote & (F.col("prev") != "quote"),
        "n_quotes_below_h1": quote & (F.col("above") == "h1"),
        "n_h2": k == "h2",
        "n_deep": k == "deep",
        "n_intro_headings": intro_heading,
        "n_links": k == "link",
        "n_links_no_desc": (k == "link") & (F.col("description") == ""),
        "n_long_desc": (k == "link") & (word_count("description") >= MAX_DESCRIPTION_WORDS),
        "n_bullets": k == "bullet",
        "n_section_text": (k == "text") & F.col("section").isNotNull(),
        "n_fence": k == "fence",
        "n_json": k == "json",
        "n_optional": (k == "h2") & (F.col("section") == OPTIONAL_SECTION),
    }
    bins = lines.groupBy(*keys, "_bin").agg(
        *[F.count_if(c).alias(n) for n, c in counts.items()],
        F.count_if(quote & F.col("prev").isNull()).alias("opens"),              # the bin's first line is a quote
        F.count_if(quote & F.col("above").isNull()).alias("leads"),             # its first line that is not blank is one
        F.max(F.struct("line_no", "kind"))["kind"].alias("last_kind"),
        F.max(F.when(k != "blank", F.struct("line_no", "kind")))["kind"].alias("last_said"),
        F.max(h2_line).alias("last_h2"))
    order = Window.partitionBy(*keys).orderBy("_bin")
    said = F.last("last_said", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    bins = bins.select(
        *keys, "last_h2", *[c for c in counts if c not in ("n_quote_blocks", "n_quotes_below_h1")],
        (F.col("n_quote_blocks") + F.when(F.coalesce(F.lag("last_kind").over(order), F.lit("")) != "quote", F.col("opens"))
         .otherwise(0)).alias("n_quote_blocks"),
        (F.col("n_quotes_below_h1") + F.when(said == "h1", F.col("leads")).otherwise(0)).alias("n_quotes_below_h1"))
    total = bins.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counts], F.max("last_h2")["section"].alias("last_section"))
    flags = {
        "h1_first": F.col("n_first_h1") > 0, "has_optional": F.col("n_optional") > 0,
        "optional_last": F.coalesce(F.col("last_section") == OPTIONAL_SECTION, F.lit(False))}
    names = ["n_lines", "n_h1", "h1_first", *[c for c in counts if c not in ("n_lines", "n_h1", "n_first_h1", "n_optional")],
             "has_optional", "optional_last"]
    out = total.select(*keys, *[flags[n].alias(n) if n in flags else F.col(n) for n in names])
    ok = ((F.col("n_h1") == 1) & F.col("h1_first") & (F.col("n_quote_blocks") == 1)
          & (F.col("n_quotes_below_h1") == 1) & (F.col("n_section_text") == 0) & (F.col("n_deep") == 0)
          & (F.col("n_intro_headings") == 0) & (F.col("n_h2") > 0) & (F.col("n_links_no_desc") == 0)
          & (F.col("n_long_desc") == 0) & (F.col("n_bullets") == 0) & (F.col("n_fence") == 0)
          & (F.col("n_json") == 0) & F.col("has_optional") & F.col("optional_last"))
    return out.withColumn("ok", ok)


def url_preservation(source_lines: DataFrame, target_lines: DataFrame, keys: list[str]) -> DataFrame:
    """URLs lost (in source, not in target) and invented (the reverse)."""
    s = source_lines.filter(F.col("kind") == "link").select(*keys, "url").distinct()
    t = target_lines.filter(F.col("kind") == "link").select(*keys, "url").distinct()
    both = s.withColumn("in_s", F.lit(True)).join(t.withColumn("in_t", F.lit(True)), keys + ["url"], "full_outer")
    return both.groupBy(*keys).agg(
        F.count_if(F.col("in_s") & F.col("in_t").isNull()).alias("n_lost"),
        F.count_if(F.col("in_t") & F.col("in_s").isNull()).alias("n_invented"),
        F.count_if(F.col("in_s") & F.col("in_t")).alias("n_kept"),
    )


def exact_duplicates(lines: DataFrame, keys: list[str]) -> DataFrame:
    """C7 (exact): a URL listed more than once in one document."""
    return (lines.filter(F.col("kind") == "link").groupBy(*keys, "url")
            .agg(F.count("*").alias("n_entries")).filter(F.col("n_entries") > 1))


def url_key(url) -> F.Column:
    """Normalised URL for near-duplicate entries: lower-case scheme and host,
    no fragment, no ``utm_*`` parameters, no trailing slash or ``.html``."""
    u = T.col(url)
    head = F.lower(F.regexp_extract(u, r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)", 1))
    rest = F.regexp_extract(u, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([^#]*)", 1)
    path = F.regexp_replace(F.regexp_extract(rest, r"^([^?]*)", 1), r"(/index)?\.html?$|/+$", "")
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    kept = F.array_join(F.filter(F.split(query, "&", -1), lambda p: (p != "") & ~p.startswith("utm_")), "&")
    return F.concat(head, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")))


def near_duplicates(lines: DataFrame, keys: list[str]) -> DataFrame:
    """C7 (near): entries whose URLs differ but normalise to one key.

    A grouping on the normalised key, so no pair of entries is ever formed.
    """
    return (lines.filter(F.col("kind") == "link").withColumn("url_key", url_key("url"))
            .groupBy(*keys, "url_key")
            .agg(F.count("*").alias("n_entries"), F.count_distinct("url").alias("n_urls"))
            .filter(F.col("n_urls") > 1))


def merge_duplicates(lines: DataFrame, keys: list[str]) -> DataFrame:
    """The line table with one entry per normalised URL, the first; it takes the first description given."""
    is_link = F.col("kind") == "link"
    entry = F.when(is_link, url_key("url"))
    links = lines.filter(is_link).withColumn("url_key", entry)
    first = links.groupBy(*keys, "url_key").agg(
        F.min("line_no").alias("line_no"),
        F.min(F.when(F.col("description") != "", F.struct("line_no", "description")))["description"].alias("_said"))
    kept = links.drop("url_key").join(first.drop("url_key"), [*keys, "line_no"])
    merged = kept.withColumn("description", F.coalesce("_said", "description")).drop("_said")
    return lines.filter(~is_link).unionByName(merged.select(*lines.columns))


def title_words(title) -> F.Column:
    """The distinct words of a title, lower-cased, in ascending order."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(T.col(title)), F.lit(r"[\p{L}\p{N}]+"), 0)))


def title_classes(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., line_no, words, class_line): entries with equal title words form a class, named after its first line.

    Written to the checkpoint folder, as it is read for every side of the joins that follow.
    """
    ensure_checkpoint_dir(lines.sparkSession)
    # a title's words are taken once, for the entries and for the classes
    entries = (lines.filter(F.col("kind") == "link").select(*keys, "line_no", title_words("title").alias("words"))
               .filter(F.size("words") > 0)).checkpoint()
    first = entries.groupBy(*keys, "words").agg(F.min("line_no").alias("class_line"))
    return entries.join(first, [*keys, "words"]).checkpoint()


def similar_classes(classes: DataFrame, keys: list[str], least: float = 0.8) -> DataFrame:
    """(keys..., class_a, class_b, similarity): classes whose word sets reach ``least`` (Jaccard), class_a < class_b.

    A set-similarity join with three filters, exact at any threshold above 0.
    Words are put in one order, rarest of the document first. Two sets of n
    and m words that reach the threshold share at least o = ceil(t / (1 + t) *
    (n + m)) words, so (prefix) they share one of the first n - ceil(t n) + 1
    words of each, (length) t n <= m <= n / t, and (position) behind a shared
    word at places i and j there must be room for o: 1 + min(n - i, m - j) >= o
    (places from 1), for the first word they share. Only classes are joined,
    never copies of a title.
    """
    reps = classes.filter(F.col("line_no") == F.col("class_line")).select(*keys, "class_line", "words")
    each = reps.select(*keys, "class_line", F.explode("words").alias("word"))
    seen = each.groupBy(*keys, "word").agg(F.count("*").alias("n"))
    ordered = each.join(seen, [*keys, "word"]).groupBy(*keys, "class_line").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("n", "word"))), lambda x: x["word"]).alias("words"))
    size = F.size("words")
    # 1e-9 keeps products like 0.8 * 5 from being rounded up past a whole number
    ceil = lambda c: F.ceil(c - F.lit(1e-9)).cast("int")
    few = size - ceil(size * F.lit(least)) + 1
    sides = ordered.select(*keys, "class_line", "words", size.alias("size"), F.posexplode(F.slice("words", F.lit(1), few)).alias("at", "word"))
    a, b = (sides.select(*keys, "word", *[F.col(c).alias(f"{c}_{s}") for c in ("class_line", "words", "size", "at")]) for s in "ab")
    shared = ceil(F.lit(least / (1 + least)) * (F.col("size_a") + F.col("size_b")))
    room = 1 + F.least(F.col("size_a") - F.col("at_a") - 1, F.col("size_b") - F.col("at_b") - 1)
    long_enough = (F.col("size_a") + 1e-9 >= F.col("size_b") * least) & (F.col("size_b") + 1e-9 >= F.col("size_a") * least)
    met = a.join(b, [*keys, "word"]).filter((F.col("class_line_a") < F.col("class_line_b")) & long_enough)
    # words are in one order, so the first shared word of the prefixes is the first shared word at all
    first = met.filter((F.array_position(F.array_intersect("words_a", "words_b"), F.col("word")) == 1) & (room >= shared))
    both = F.size(F.array_intersect("words_a", "words_b"))
    similarity = both / (F.col("size_a") + F.col("size_b") - both)
    return first.select(*keys, F.col("class_line_a").alias("class_a"), F.col("class_line_b").alias("class_b"),
                        similarity.alias("similarity")).filter(F.col("similarity") >= least)


def similar_title_classes(lines: DataFrame, keys: list[str], least: float = 0.8) -> DataFrame:
    """C7 on titles: (keys..., line_no, class_line, similar_class, similarity).

    One row per entry with its class (``similar_class`` null), and one per pair
    of similar classes (``line_no`` null, ``class_line`` < ``similar_class``).
    Entries of linked classes are similar, entries of one class equal.
    """
    classes = title_classes(lines, keys)
    pairs = similar_classes(classes, keys, least)
    return classes.select(*keys, "line_no", "class_line", F.lit(None).cast("int").alias("similar_class"),
                          F.lit(None).cast("double").alias("similarity")).unionByName(
        pairs.select(*keys, F.lit(None).cast("int").alias("line_no"), F.col("class_a").alias("class_line"),
                     F.col("class_b").alias("similar_class"), "similarity"))


def similar_titles(lines: DataFrame, keys: list[str], least: float = 0.8) -> DataFrame:
    """C7 on titles as pairs of entries: (keys..., line_a, line_b, similarity).

    Classes are compared, and only what is found is written out as pairs of
    their entries: n equal titles are n (n - 1) / 2 rows. ``similar_title_classes``
    gives the same without expanding them.
    """
    classes = title_classes(lines, keys)
    member = lambda c, line: classes.select(*keys, F.col("class_line").alias(c), F.col("line_no").alias(line))
    equal = (member("c", "line_a").join(member("c", "line_b"), [*keys, "c"]).filter("line_a < line_b")
             .select(*keys, "line_a", "line_b", F.lit(1.0).alias("similarity")))
    apart = (similar_classes(classes, keys, least).join(member("class_a", "x"), [*keys, "class_a"]).join(member("class_b", "y"), [*keys, "class_b"])
             .select(*keys, F.least("x", "y").alias("line_a"), F.greatest("x", "y").alias("line_b"), "similarity"))
    return equal.unionByName(apart)


def connected(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., node, root): the smallest node of every node's component, by star contraction.

    ``edges``: (keys..., a, b). In turn every larger neighbour of a node is
    tied to the node's smallest neighbour, and every node and its smaller
    neighbours to the smallest of them, until nothing changes. Rounds are
    logarithmic in the length of chains; each is written to the checkpoint
    folder.
    """
    spark = edges.sparkSession
    ensure_checkpoint_dir(spark)
    pair = lambda u, v: F.struct(F.col(u).alias("u"), F.col(v).alias("v"))

    def digest(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64(*keys, "u", "v").cast("decimal(38,0)"))).first())

    e = edges.select(*keys, F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct().checkpoint()
    before = digest(e)
    while True:
        both = e.select(*keys, F.explode(F.array(pair("u", "v"), pair("v", "u"))).alias("e")).select(*keys, "e.*")
        low = both.groupBy(*keys, "u").agg(F.min("v").alias("m")).select(*keys, "u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, [*keys, "u"]).select(*keys, F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy(*keys, "u").agg(F.min("v").alias("m"))
        small = large.join(least, [*keys, "u"]).select(*keys, F.explode(F.array(pair("u", "m"), pair("v", "m"))).alias("e"))
        e = small.select(*keys, "e.*").filter("u != v").distinct().checkpoint()
        after = digest(e)
        if after == before:
            break
        before = after
    return e.select(*keys, F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(*keys, F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def merge_similar(lines: DataFrame, keys: list[str], least: float = 0.8) -> DataFrame:
    """The line table with one entry per class of duplicates by URL or title, the first; it takes the first description given.

    Entries are duplicates if their URLs normalise to one key or their titles
    are similar, directly or through others (a ~ b ~ c is one class).
    """
    is_link = F.col("kind") == "link"
    links = lines.filter(is_link).withColumn("url_key", url_key("url"))
    # every entry is tied to the first of its URL and the first of its title words, and similar titles to one another
    by_url = links.groupBy(*keys, "url_key").agg(F.min("line_no").alias("b"))
    classes = title_classes(lines, keys)
    edges = (links.join(by_url, [*keys, "url_key"]).select(*keys, F.col("line_no").alias("a"), "b")
             .unionByName(classes.select(*keys, F.col("line_no").alias("a"), F.col("class_line").alias("b")))
             .unionByName(similar_classes(classes, keys, least).select(*keys, F.col("class_a").alias("a"), F.col("class_b").alias("b"))))
    roots = connected(edges, keys).select(*keys, F.col("node").alias("line_no"), "root")
    entries = links.drop("url_key").join(roots, [*keys, "line_no"], "left").withColumn("root", F.coalesce("root", "line_no"))
    said = entries.filter(F.col("description") != "").groupBy(*keys, "root").agg(
        F.min_by("description", "line_no").alias("_said"))
    merged = (entries.filter(F.col("line_no") == F.col("root")).join(said, [*keys, "root"], "left")
              .withColumn("description", F.coalesce("_said", "description")))
    return lines.filter(~is_link).unionByName(merged.select(*lines.columns))
