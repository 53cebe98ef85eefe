"""String expressions that follow Python's str semantics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# Characters for which Python's str.isspace() is true; this is what Python's
# str.strip() removes and what re's \s matches on str patterns. Written as a
# regex class that Java regex and RE2 both read.
PY_WS_CLASS = (
    r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
# ASCII whitespace as HTML attribute syntax uses it.
ASCII_WS_CLASS = r"[\t\n\x{0B}\f\r ]"
FENCE = "```"
EXCERPT_CHARS = 500
# ---------------------------------------------------------------------------

_BIG = 1 << 30


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """Python ``str.strip()``: Unicode whitespace at both ends."""
    return F.regexp_replace(col(c), rf"^{PY_WS_CLASS}+|{PY_WS_CLASS}+\z", "")


def collapse_ws(c) -> Column:
    """``re.sub(r'\\s+', ' ', t)`` with Python's Unicode \\s."""
    return F.regexp_replace(col(c), f"{PY_WS_CLASS}+", " ")


def py_capitalize(c) -> Column:
    """Python ``str.capitalize()`` for one token."""
    c = col(c)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, _BIG)))


def py_title(c) -> Column:
    """P6 core: Python ``str.title()`` -- upper after every non-letter run."""
    runs = F.regexp_extract_all(col(c), F.lit(r"\p{L}+|\P{L}+"), 0)
    return F.array_join(F.transform(runs, py_capitalize), "")


def link_line(title, url) -> Column:
    """``- [title](url)`` with no markdown escaping."""
    return F.concat(F.lit("- ["), col(title), F.lit("]("), col(url), F.lit(")"))


def strip_code_fence(c) -> Column:
    """P10: drop a wrapping code fence the way the rewrite step does.

    Trim; if the text starts with three backticks drop line 1, and the last
    line too when it is a bare fence; trim again.
    """
    s = py_strip(col(c))
    lines = F.split(s, "\n", -1)
    n = F.size(lines)
    last_is_fence = py_strip(F.element_at(lines, -1)) == F.lit(FENCE)
    body = F.when(last_is_fence, F.slice(lines, 2, F.greatest(n - 2, F.lit(0)))) \
            .otherwise(F.slice(lines, 2, F.greatest(n - 1, F.lit(0))))
    return F.when(s.startswith(FENCE), py_strip(F.array_join(body, "\n"))).otherwise(s)


def excerpt(c, n: int = EXCERPT_CHARS) -> Column:
    """First ``n`` characters followed by ``...``."""
    return F.concat(F.substring(col(c), 1, n), F.lit("..."))


# Java format patterns that give what Python's ".1f" and "+.0f" give: both round the exact binary value, ties to even.
ONE_DECIMAL = "0.0"
SIGNED_WHOLE = "+0;-0"


def number_text(c, pattern: str = ONE_DECIMAL) -> Column:
    """A report number as text (JVM-side, null stays null)."""
    return F.call_function("format_number", col(c).cast("double"), F.lit(pattern))


def signed(c) -> Column:
    """``+`` only for positive values, then the number with one decimal."""
    c = col(c)
    return F.concat(F.when(c > 0, F.lit("+")).otherwise(F.lit("")), number_text(c))
