"""DuckDB (RE2) spellings of the library's expressions, used only to write
the oracle SQL that checks each registered query."""

from __future__ import annotations

from ..functions.text import SQL_SPACE, SQL_STRIP_CLASS, SQL_TOKEN_PATTERN
from ..sources.tables import SQL_DOCUMENTS

DOCS = SQL_DOCUMENTS


def tok(t: str) -> str:
    return f"regexp_extract_all({t}, '{SQL_TOKEN_PATTERN}')"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SQL_STRIP_CLASS}+|{SQL_STRIP_CLASS}+$', '', 'g')"


def chars(t: str) -> str:
    return f"regexp_extract_all({t}, '(?s).')"


def lines_nl(t: str) -> str:
    return f"string_split({t}, chr(10))"


def ngrams(k: str, n: int) -> str:
    """n-grams joined by a space from shifted slices (the list is referenced
    outside the lambda, so it is evaluated once)."""
    if n == 1:
        return k
    slices = ", ".join(f"{k}[{j + 1}:len({k}) - {n - 1 - j}]" for j in range(n))
    parts = ", ".join(f"z[{j + 1}]" for j in range(n))
    return (f"(CASE WHEN len({k}) >= {n} THEN list_transform(list_zip({slices}), "
            f"lambda z: concat_ws(' ', {parts})) ELSE []::VARCHAR[] END)")


def div(num: str, den: str) -> str:
    return f"(CASE WHEN ({den}) <> 0 THEN ({num})::DOUBLE / ({den})::DOUBLE END)"


def cnt(arr: str, lam: str) -> str:
    return f"len(list_filter({arr}, {lam}))"


def entropy(arr: str) -> str:
    return f"(CASE WHEN len({arr}) > 0 THEN greatest(list_aggregate({arr}, 'entropy'), 0.0) ELSE 0.0 END)"


def metric_sql(name: str, t: str = "text", k: str = "tokens") -> str:
    """SQL for one registered metric, over text column ``t`` and token list ``k``."""
    L = lines_nl(t)
    m = {
        "length_chars": f"length({t})::BIGINT",
        "length_words": f"len({k})::BIGINT",
        "unique_words": f"len(list_distinct({k}))::BIGINT",
        "unique_trigrams": f"len(list_distinct({ngrams(k, 3)}))::BIGINT",
        "unique_chars": f"len(list_distinct({chars(t)}))::BIGINT",
        "unique_char_trigrams": f"len(list_distinct({ngrams(chars(t), 3)}))::BIGINT",
        "alpha_chars": f"len(regexp_extract_all({t}, '\\p{{L}}'))::BIGINT",
        "num_lines": f"len({L})::BIGINT",
        "frac_all_caps_words": div(cnt(k, "lambda w: regexp_matches(w, '\\p{Lu}') AND NOT regexp_matches(w, '[\\p{Ll}\\p{Lt}]')"), f"len({k})"),
        "frac_no_script_words": div(cnt(k, "lambda w: regexp_matches(w, '^[\\p{L}\\p{M}]')"), f"len({k})"),
        "doc_mean_word_length": div(f"length({t})", f"len({k})"),
        "frac_unique_words": div(f"len(list_distinct({k}))", f"len({k})"),
        "frac_unique_trigrams": f"(CASE WHEN len({k}) >= 3 THEN {div(f'len(list_distinct({ngrams(k, 3)}))', f'len({k}) - 2')} ELSE 0.0 END)",
        "frac_unique_chars": div(f"len(list_distinct({chars(t)}))", f"length({t})"),
        "frac_lines_end_ellipsis": div(cnt(L, f"lambda l: suffix({strip('l')}, '...') OR suffix({strip('l')}, '…')"), f"len({L})"),
        "frac_symbol_to_words": div(cnt(k, "lambda w: w IN ('#', '...', '…')"), f"len({k})"),
        "frac_pipes_in_words": div(cnt(k, "lambda w: contains(w, '|')"), f"length({t})"),
        "unigram_entropy": entropy(k),
        "trigram_entropy": entropy(ngrams(k, 3)),
        "char_entropy": entropy(chars(t)),
        "lines_end_with_punctuation": div(cnt(L, f"lambda l: regexp_matches({strip('l')}, '\\p{{P}}$')"), f"len({L})"),
        "num_words_per_line": div(f"len({tok(t)})", f"len({L})"),
    }
    return m[name]


FLOAT_METRICS = {
    "frac_all_caps_words", "frac_no_script_words", "doc_mean_word_length", "frac_unique_words",
    "frac_unique_trigrams", "frac_unique_chars", "frac_lines_end_ellipsis", "frac_symbol_to_words",
    "frac_pipes_in_words", "unigram_entropy", "trigram_entropy", "char_entropy",
    "lines_end_with_punctuation", "num_words_per_line",
}


def metric_out(name: str, t: str = "text", k: str = "tokens") -> str:
    e = metric_sql(name, t, k)
    return f"round({e}, 6) AS {name}" if name in FLOAT_METRICS else f"{e} AS {name}"


# --- line cleaning ----------------------------------------------------------
SQL_SPLITLINES = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}\x{1d}\x{1e}\x{85}\x{2028}\x{2029}]"
SQL_ACCEPTED = r"\p{M}\p{P}\p{S}\p{N}\p{Z}\p{C}"
SQL_SCRIPT_NAMES = {"Latn": "Latin", "Cyrl": "Cyrillic", "Grek": "Greek", "Hani": "Han",
                    "Arab": "Arabic", "Deva": "Devanagari", "Hira": "Hiragana", "Kana": "Katakana",
                    "Hang": "Hangul", "Ethi": "Ethiopic"}


def splitlines(t: str) -> str:
    return f"regexp_split_to_array({t}, '{SQL_SPLITLINES}')"


def script_line(l: str, scripts) -> str:
    scr = "".join(f"\\p{{{SQL_SCRIPT_NAMES[s]}}}" for s in scripts)
    return (f"array_to_string(list_filter(regexp_extract_all({l}, '[{SQL_ACCEPTED}{scr}]+'), "
            f"lambda r: regexp_matches(r, '[{scr}]')), '')")


def bracket_line(l: str) -> str:
    return (f"regexp_replace(regexp_replace({l}, '[\\(\\[\\{{][^\\p{{L}}]+[\\)\\]\\}}]', ' ', 'g'), "
            f"'[{SQL_SPACE}]+', ' ', 'g')")


def c4_line_ok(l: str) -> str:
    return (f"({strip(l)} <> '' AND regexp_matches({l}, '[\\p{{Po}}\\p{{Pf}}]$') "
            f"AND len(regexp_extract_all({l}, '[^{SQL_SPACE}\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Nl}}\\p{{Pc}}]')) >= 5 "
            f"AND NOT contains(lower({l}), 'lorem ipsum'))")


def clean_lines(t: str, scripts=None, c4: bool = False, brackets: bool = True) -> str:
    lines = f"list_filter(list_transform({splitlines(t)}, lambda l: {strip('l')}), lambda l: l <> '')"
    if scripts:
        inner = script_line("l", scripts)
        if brackets:
            inner = bracket_line(inner)
        lines = f"list_filter(list_transform({lines}, lambda l: {inner}), lambda l: {strip('l')} <> '')"
    if c4:
        lines = f"list_filter({lines}, lambda l: {c4_line_ok('l')})"
    return f"array_to_string({lines}, chr(10))"


#: Weights of the languages of ``d``: their documents.
COUNTS = "SELECT language, count(*)::DOUBLE AS w FROM d GROUP BY language"


def sample_sql(docs: str, weights: str, raw: str, stop: str, seed: int = 42, extra: str = "") -> str:
    """Language sampling by probability: draws from md5 of (seed, t), the k-th
    draw of a language takes its row k mod n, and the output ends at the first
    (``stop`` = min) or the last (max) language's last row."""
    return f"""
WITH d AS ({docs}), w AS ({weights}),
p AS (SELECT language, ({raw})::DOUBLE / sum(({raw})::DOUBLE) OVER () AS p FROM w),
iv AS (SELECT language, sum(p) OVER (ORDER BY language) - p AS lo0, sum(p) OVER (ORDER BY language) AS hi0,
              row_number() OVER (ORDER BY language DESC) AS back FROM p),
iv2 AS (SELECT language, coalesce(lag(hi0) OVER (ORDER BY language), 0.0) AS lo,
               CASE WHEN back = 1 THEN 2.0 ELSE hi0 END AS hi FROM iv),
u AS (SELECT t, ('0x' || substr(md5('draw{seed}:' || t::VARCHAR), 1, 13))::BIGINT / 4503599627370496.0 AS u
      FROM (SELECT unnest(range(0, (SELECT 40 * count(*) FROM d))) AS t)),
n AS (SELECT language, count(*) AS n FROM d GROUP BY language),
k AS (SELECT t, language, n, row_number() OVER (PARTITION BY language ORDER BY t) - 1 AS k
      FROM u JOIN iv2 ON u >= lo AND u < hi JOIN n USING (language)),
s AS (SELECT {stop}(t) AS stop FROM (SELECT min(t) AS t FROM k WHERE k = n - 1 GROUP BY language)),
i AS (SELECT *, row_number() OVER (PARTITION BY language ORDER BY id) - 1 AS i FROM d)
SELECT k.t, i.id, i.language{extra} FROM k JOIN s ON k.t <= s.stop
JOIN i ON i.language = k.language AND i.i = k.k % k.n"""


def greedy_sql(edges: str) -> str:
    """Ids that greedy deduplication drops, from ``(id, bucket)``: rounds over
    the state of every document (0 open, 1 kept, 2 dropped)."""
    return f"""
WITH RECURSIVE e AS MATERIALIZED (
  SELECT id, bucket FROM (SELECT id, bucket, count(*) OVER (PARTITION BY bucket) AS c FROM ({edges})) WHERE c > 1),
r(n, id, st) AS (
  SELECT 0, id, 0 FROM (SELECT DISTINCT id FROM e)
  UNION ALL
  SELECT n + 1, id, CASE WHEN st <> 0 THEN st WHEN bool_or(coalesce(m_k < id, false)) THEN 2
                         WHEN bool_and(m_nd = id) THEN 1 ELSE 0 END
  FROM (SELECT r.n, e.id, r.st, min(CASE WHEN r.st <> 2 THEN e.id END) OVER (PARTITION BY e.bucket) AS m_nd,
               min(CASE WHEN r.st = 1 THEN e.id END) OVER (PARTITION BY e.bucket) AS m_k,
               bool_or(r.st = 0) OVER () AS more
        FROM r JOIN e ON r.id = e.id) WHERE more GROUP BY n, id, st)
SELECT DISTINCT id FROM r WHERE st = 2"""
