"""Column-level text primitives: tokens, n-grams, stripping and lines.

Everything here returns a native Spark ``Column`` (JVM regex and array
functions), so it stays inside the executor's codegen/interpreter and never
crosses into Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's behaviour)
# ---------------------------------------------------------------------------
# Word runs or a single character that is neither a word character nor space.
# (?U) switches Java's \w and \s to their Unicode definitions, which is what
# the Python ``regex`` module uses by default.
TOKEN_PATTERN = r"(?U)\w+|[^\w\s]"
# Characters Python's str.strip() removes: Unicode white space plus the
# information separators U+001C..U+001F.
_STRIP_CLASS = r"[\s\x{1c}-\x{1f}]"
STRIP_PATTERN = rf"(?U)^{_STRIP_CLASS}+|{_STRIP_CLASS}+$"
# Line boundaries of Python's str.splitlines().
SPLITLINES_PATTERN = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}\x{1d}\x{1e}\x{85}\x{2028}\x{2029}]"
WHITESPACE_RUN = r"(?U)\s+"

# Portable (RE2) spellings of the same classes, for DuckDB oracles.
SQL_WORD = r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}"
SQL_SPACE = r"\x{09}-\x{0d}\x{85}\p{Z}"
SQL_TOKEN_PATTERN = rf"[{SQL_WORD}]+|[^{SQL_WORD}{SQL_SPACE}]"
SQL_STRIP_CLASS = rf"[{SQL_SPACE}\x{{1c}}-\x{{1f}}]"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def tokenize(text) -> Column:
    """Default word tokenizer: ``\\w+`` runs or one non-space symbol."""
    return F.regexp_extract_all(_c(text), F.lit(TOKEN_PATTERN), 0)


# Characters Python's str.strip() removes (str.isspace()), spelled out so the
# native btrim can remove them from both ends without a regex scan.
PY_WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x20\x85\xa0\u1680"
                 + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000")
# The same set minus the newline, for "end of line" tests on \n-separated lines.
PY_WHITESPACE_NO_NL = PY_WHITESPACE.replace("\n", "")


def strip(text) -> Column:
    """Python ``str.strip()`` on a string column (Spark ``trim`` only removes
    U+0020); native ``btrim`` with the fixed white-space set."""
    return F.btrim(_c(text), F.lit(PY_WHITESPACE))


def is_blank(text) -> Column:
    return strip(text) == F.lit("")


def splitlines(text) -> Column:
    """Python ``str.splitlines()`` boundaries (trailing empty piece is kept;
    callers that drop blank lines do not care)."""
    return F.split(_c(text), SPLITLINES_PATTERN, -1)


def newline_lines(text) -> Column:
    """``text.split('\\n')`` — the notion of line used by the quality metrics."""
    return F.split(_c(text), "\n", -1)


def word_ngrams(tokens, n: int) -> Column:
    """Token n-grams joined by a space, empty when there are fewer than n tokens.

    Built from ``n`` shifted slices combined with ``zip_with``, so the token
    array is referenced only outside the lambdas (linear; referencing an
    array expression inside a lambda would re-evaluate it per element)."""
    toks = _c(tokens)
    if n == 1:
        return toks
    m = F.size(toks) - (n - 1)
    acc = F.slice(toks, 1, m)
    for j in range(1, n):
        acc = F.zip_with(acc, F.slice(toks, j + 1, m), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.when(m >= 1, acc).otherwise(F.array().cast("array<string>"))


def chars(text) -> Column:
    """Array of code points of a string (empty array for the empty string)."""
    t = _c(text)
    return F.when(F.length(t) > 0, F.split(t, "")).otherwise(F.array().cast("array<string>"))


def char_ngrams(text, n: int) -> Column:
    """Character n-grams (code points, joined by a space) of a string, empty
    when shorter than n.

    The characters, with a space between them, are one string, of which each
    match looks at one n-gram and takes one character and its space: no lambda
    runs for every character."""
    if n == 1:
        return chars(text)
    spaced = F.array_join(F.split(F.coalesce(_c(text), F.lit("")), ""), " ")
    return F.regexp_extract_all(spaced, F.lit(f"(?s)(?=({' '.join('.' * n)})). "), 1)


def sql_tokenize(text_sql: str) -> str:
    """DuckDB expression for :func:`tokenize`."""
    return f"regexp_extract_all({text_sql}, '{SQL_TOKEN_PATTERN}')"


def sql_strip(text_sql: str) -> str:
    return (f"regexp_replace({text_sql}, '^{SQL_STRIP_CLASS}+|{SQL_STRIP_CLASS}+$', '', 'g')")
