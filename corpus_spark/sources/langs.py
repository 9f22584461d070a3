"""Language dimension: ISO 639-3 id, name, BCP-47 tag, Wikipedia id, scripts
and the corpus sources a language is available in.

A small built-in table of languages; :func:`use_language_table` adds a table of
any size that the caller reads.  It is a dimension: one row for each language,
held by the driver and joined with ``broadcast``.  The built-in rows name all
sources there is an adapter for, as availability is the caller's matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# ---------------------------------------------------------------------------
# Fixed values: (id, language name, bcp_47, wiki_id, scripts, sources)
# ---------------------------------------------------------------------------
LANGUAGES = [
    ("hau", "Hausa", "ha", "ha", ["Latn"], ["wiki", "mc4", "bible", "nllb", "fineweb"]),
    ("yor", "Yoruba", "yo", "yo", ["Latn"], ["wiki", "mc4", "bible", "nllb", "fineweb"]),
    ("swa", "Swahili", "sw", "sw", ["Latn"], ["wiki", "mc4", "bible", "nllb", "fineweb"]),
    ("eng", "English", "en", "en", ["Latn"], ["wiki", "mc4", "bible", "nllb", "fineweb"]),
    ("fra", "French", "fr", "fr", ["Latn"], ["wiki", "mc4", "bible", "nllb", "fineweb"]),
    ("deu", "German", "de", "de", ["Latn"], ["wiki", "mc4", "bible", "nllb", "fineweb"]),
    ("spa", "Spanish", "es", "es", ["Latn"], ["wiki", "mc4", "bible", "nllb", "fineweb"]),
    ("rus", "Russian", "ru", "ru", ["Cyrl"], ["wiki", "mc4", "bible", "nllb", "fineweb"]),
    ("ell", "Greek", "el", "el", ["Grek"], ["wiki", "mc4", "bible", "nllb", "fineweb"]),
    ("zho", "Chinese", "zh", "zh", ["Hani"], ["wiki", "mc4", "bible", "nllb", "fineweb"]),
    ("jpn", "Japanese", "ja", "ja", ["Hani", "Hira", "Kana"], ["wiki", "mc4", "bible", "nllb", "fineweb"]),
    ("arb", "Arabic", "ar", "ar", ["Arab"], ["wiki", "mc4", "bible", "nllb", "fineweb"]),
    ("hin", "Hindi", "hi", "hi", ["Deva"], ["wiki", "mc4", "bible", "nllb", "fineweb"]),
    ("amh", "Amharic", "am", "am", ["Ethi"], ["wiki", "mc4", "bible", "nllb", "fineweb"]),
    ("ibo", "Igbo", "ig", "ig", ["Latn"], ["wiki", "mc4", "bible", "nllb", "fineweb"]),
    ("zul", "Zulu", "zu", "zu", ["Latn"], ["wiki", "mc4", "bible", "nllb", "fineweb"]),
    ("tur", "Turkish", "tr", "tr", ["Latn"], ["wiki", "mc4", "bible", "nllb", "fineweb"]),
    ("kor", "Korean", "ko", "ko", ["Hang"], ["wiki", "mc4", "bible", "nllb", "fineweb"]),
]

# Sources a corpus can be loaded from (adapters live in sources/adapters.py).
KNOWN_SOURCES = ("wiki", "mc4", "bible", "nllb", "fineweb")

_BY_ID = {row[0]: row for row in LANGUAGES}
_BY_ANY = {}
for _row in LANGUAGES:
    for _alias in (_row[0], _row[2], _row[3]):
        _BY_ANY.setdefault(_alias, _row)


def lookup(code: str) -> dict:
    """Resolve a language by iso3 id (or BCP-47 / wiki id); unknown -> ValueError."""
    row = _BY_ID.get(code) or _BY_ANY.get(code)
    if row is None:
        raise ValueError(f"Invalid language code: {code}")
    return dict(zip(("id", "language", "bcp_47", "wiki_id", "scripts", "sources"), row))


def aliases(code: str) -> list[str]:
    """Names a saved corpus may use for this language, in fallback order:
    iso3, wiki id, BCP-47."""
    info = lookup(code)
    return list(dict.fromkeys([info["id"], info["wiki_id"], info["bcp_47"]]))


def iso3(code: str) -> str:
    return lookup(code)["id"]


def language_table(spark: SparkSession) -> DataFrame:
    """The registry as a DataFrame, one row per language."""
    return spark.createDataFrame(
        [list(r) for r in _BY_ID.values()],
        "id string, language string, bcp_47 string, wiki_id string, scripts array<string>, sources array<string>")


def list_languages(spark: SparkSession) -> DataFrame:
    """All languages ordered by name, with scripts and sources."""
    return language_table(spark).orderBy("language")


def use_language_table(df: DataFrame) -> int:
    """Add the languages of a table (id, language, bcp_47, wiki_id, scripts,
    sources; all but id may be NULL) to the registry, in place of built-in rows
    with the same id.  Returns the number of languages known."""
    for r in df.select("id", "language", "bcp_47", "wiki_id", "scripts", "sources").collect():
        if not r["id"]:
            raise ValueError("A language needs an id.")
        row = (r["id"], r["language"] or r["id"], r["bcp_47"] or r["id"], r["wiki_id"] or r["bcp_47"] or r["id"],
               list(r["scripts"] or ["Latn"]), list(r["sources"] if r["sources"] is not None else KNOWN_SOURCES))
        _BY_ID[row[0]] = row
        for alias in (row[0], row[2], row[3]):
            _BY_ANY[alias] = row
    return len(_BY_ID)


def scripts_for(codes) -> dict[str, list[str]]:
    return {iso3(c): lookup(c)["scripts"] for c in codes}
