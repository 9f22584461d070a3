"""Per-document quality signals as native Column expressions.

A metric is a function ``(text, tokens) -> Column`` plus a direction flag
(``higher_is_better``).  The registry maps metric names to metrics; users add
their own with :func:`register_metric` (any Column expression, including a
``pandas_udf`` call).  Metrics that would divide by zero return NULL, and the
threshold filter treats NULL as failing.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .counts import char_entropy, distinct_char_ngrams, distinct_token_ngrams, token_entropy
from .text import PY_WHITESPACE_NO_NL, TOKEN_PATTERN, chars, newline_lines, strip

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's behaviour)
# ---------------------------------------------------------------------------
SYMBOL_TOKENS = ("#", "...", "…")   # '#', three dots, horizontal ellipsis
ELLIPSIS_ENDINGS = ("...", "…")
PIPE = "|"


@dataclass(frozen=True)
class Metric:
    name: str
    fn: Callable[[Column, Column], Column]
    higher_is_better: bool = True
    needs_tokens: bool = True


REGISTRY: dict[str, Metric] = {}


def register_metric(name: str, fn: Callable[[Column, Column], Column],
                    higher_is_better: bool = True, needs_tokens: bool = True,
                    replace: bool = False) -> Metric:
    if name in REGISTRY and not replace:
        raise ValueError(f"Metric already registered: {name}")
    m = Metric(name, fn, higher_is_better, needs_tokens)
    REGISTRY[name] = m
    return m


def get_metric(name: str) -> Metric:
    if name == "combined_metrics":
        return Metric("combined_metrics", lambda t, k: F.col("combined_metrics"), True, False)
    if name == "perplexity":  # lower is better; a column that operators.lm adds
        return Metric("perplexity", _no_perplexity, False, False)
    if name not in REGISTRY:
        raise ValueError(f"Unknown metric: {name}")
    return REGISTRY[name]


def _no_perplexity(t: Column, k: Column) -> Column:
    raise ValueError("perplexity needs a language model: add it with operators.lm.perplexity_signal")


def _div(num: Column, den: Column) -> Column:
    """num / den as DOUBLE, NULL when den is 0 (the reference raises there)."""
    return F.when(den != 0, num.cast("double") / den.cast("double"))


def _count(arr: Column, pred) -> Column:
    return F.size(F.filter(arr, pred))


def entropy(arr: Column) -> Column:
    """Shannon entropy (bits) of the values of an array, per row, no shuffle:
    sort once, fold runs of equal values in a single ``aggregate`` pass
    (state: previous value, run length, sum of c*log2 c), then
    H = log2 N - sum(c log2 c) / N.  The sorted array is referenced exactly
    once, so nothing is re-evaluated per element.  Empty arrays give 0.0."""
    def xlogx(c):
        return F.when(c > 1, c.cast("double") * F.log2(c.cast("double"))).otherwise(F.lit(0.0))

    srt = F.array_sort(arr)
    init = F.struct(F.lit(None).cast("string").alias("p"), F.lit(0).cast("long").alias("r"),
                    F.lit(0.0).alias("a"))

    def step(st, x):
        same = st["p"].isNotNull() & (st["p"] == x)
        return F.when(same, F.struct(st["p"].alias("p"), (st["r"] + 1).alias("r"), st["a"].alias("a"))) \
            .otherwise(F.struct(x.alias("p"), F.lit(1).cast("long").alias("r"),
                                (st["a"] + xlogx(st["r"])).alias("a")))

    acc = F.aggregate(srt, init, step, lambda st: st["a"] + xlogx(st["r"]))
    n = F.size(arr).cast("double")
    h = F.log2(n) - acc / n
    # +0.0 rather than -0.0 or tiny negatives from rounding
    return F.when(F.size(arr) > 0, F.greatest(h, F.lit(0.0))).otherwise(F.lit(0.0))


def _cls(chars_: str) -> str:
    """A regex character class matching exactly the given characters."""
    return "[" + "".join(f"\\x{{{ord(c):x}}}" for c in chars_) + "]"


_H = _cls(PY_WHITESPACE_NO_NL)   # strip()-able characters other than the newline


NTOK, NLINES = "__ntok", "__nlines"


def n_tokens(text: Column) -> Column:
    """Token count, computed once per document by ``compute_metrics`` (column
    ``__ntok``: ``size(tokens)`` when the array exists, else a regex count)."""
    return F.col(NTOK)


def n_nl_lines(text: Column) -> Column:
    """Lines on \\n, computed once per document (column ``__nlines``)."""
    return F.col(NLINES)


def char_count(text: Column, ch: str) -> Column:
    """Occurrences of one character: native replace + length, no regex."""
    return F.length(text) - F.length(F.replace(text, F.lit(ch), F.lit("")))


def shared_inputs(text: Column, tokens: Column | None) -> list[Column]:
    ntok = F.size(tokens) if tokens is not None else F.regexp_count(text, F.lit(TOKEN_PATTERN))
    return [ntok.alias(NTOK), (char_count(text, "\n") + 1).alias(NLINES)]


def _lines_ending(text: Column, ending_regex: str) -> Column:
    """Lines (split on \n) whose stripped form ends with ``ending_regex``:
    the ending, then only strip()-able characters, then \n or the end."""
    return F.regexp_count(text, F.lit(rf"(?:{ending_regex}){_H}*(?:\n|\z)"))


def _lines_stripped(text: Column) -> Column:
    return F.transform(newline_lines(text), lambda ln: strip(ln))


_BUILTIN = [
    ("length_chars", lambda t, k: F.length(t).cast("long"), True, False),
    ("length_words", lambda t, k: n_tokens(t).cast("long"), True, False),
    ("unique_words", lambda t, k: F.size(F.array_distinct(k)).cast("long"), True, True),
    ("unique_trigrams", lambda t, k: distinct_token_ngrams(k, 3), True, True),
    ("unique_chars", lambda t, k: F.size(F.array_distinct(chars(t))).cast("long"), True, False),
    ("unique_char_trigrams",
     lambda t, k: distinct_char_ngrams(t, 3), True, False),
    ("alpha_chars", lambda t, k: F.regexp_count(t, F.lit(r"\p{L}")).cast("long"), True, False),
    ("num_lines", lambda t, k: n_nl_lines(t).cast("long"), True, False),
    ("frac_all_caps_words",
     lambda t, k: _div(_count(k, lambda w: w.rlike(r"\p{IsUppercase}")
                              & ~w.rlike(r"[\p{IsLowercase}\p{Lt}]")), F.size(k)), True, True),
    # A token starts with a letter/mark iff it is a word run (tokens of one
    # symbol are never letters) whose first character is L or M, i.e. an L/M
    # character not preceded by a word character: a native count, no array.
    ("frac_no_script_words",
     lambda t, k: _div(F.regexp_count(t, F.lit(r"(?U)(?<!\w)[\p{L}\p{M}]")), n_tokens(t)), True, False),
    ("doc_mean_word_length", lambda t, k: _div(F.length(t), n_tokens(t)), True, False),
    ("frac_unique_words", lambda t, k: _div(F.size(F.array_distinct(k)), F.size(k)), True, True),
    ("frac_unique_trigrams",
     lambda t, k: F.when(F.size(k) >= 3, _div(distinct_token_ngrams(k, 3), F.size(k) - 2))
     .otherwise(F.lit(0.0)), True, True),
    ("frac_unique_chars", lambda t, k: _div(F.size(F.array_distinct(chars(t))), F.length(t)), True, False),
    ("frac_lines_end_ellipsis",
     lambda t, k: _div(_lines_ending(t, r"\.\.\.|\x{2026}"), n_nl_lines(t)), False, False),
    # Symbols are one-character tokens, so "..." is never a token: the count is
    # the number of '#' and U+2026 characters.
    ("frac_symbol_to_words",
     lambda t, k: _div(char_count(t, "#") + char_count(t, "\u2026"), n_tokens(t)), False, False),
    ("frac_pipes_in_words",
     lambda t, k: _div(_count(k, lambda w: w.contains(PIPE)), F.length(t)), False, True),
    ("unigram_entropy", lambda t, k: token_entropy(k), True, True),
    ("trigram_entropy", lambda t, k: token_entropy(k, 3), True, True),
    ("char_entropy", lambda t, k: char_entropy(t), True, False),
    ("lines_end_with_punctuation",
     lambda t, k: _div(_lines_ending(t, r"\p{P}"), n_nl_lines(t)), True, False),
    # Tokens never span a newline, so the per-line token sum equals the
    # document's token count (always with the default tokenizer).
    ("num_words_per_line",
     lambda t, k: _div(n_tokens(t), n_nl_lines(t)), True, False),
]

for _name, _fn, _hib, _nt in _BUILTIN:
    register_metric(_name, _fn, _hib, _nt)

#: The signals above that count default tokens in the text, over the tokens of
#: another tokenizer.  (num_words_per_line has default tokens always.)
TOKEN_FORMS: dict[str, Callable[[Column, Column], Column]] = {
    "length_words": lambda t, k: F.size(k).cast("long"),
    "doc_mean_word_length": lambda t, k: _div(F.length(t), F.size(k)),
    "frac_no_script_words": lambda t, k: _div(_count(k, lambda w: w.rlike(r"^[\p{L}\p{M}]")), F.size(k)),
    "frac_symbol_to_words": lambda t, k: _div(_count(k, lambda w: w.isin(*SYMBOL_TOKENS)), F.size(k)),
    "num_words_per_line": lambda t, k: _div(F.regexp_count(t, F.lit(TOKEN_PATTERN)), n_nl_lines(t)),
}

# Gopher quality preset (fixed values).
GOPHER_THRESHOLDS = {
    "length_words": 50,
    "doc_mean_word_length": 3,
    "frac_lines_end_ellipsis": 0.3,
    "frac_symbol_to_words": 0.1,
    "frac_no_script_words": 0.8,
}
