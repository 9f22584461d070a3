"""Saving and loading corpora, weight files and dependency treebanks."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .langs import aliases


def save_corpus(df: DataFrame, path: str, by_language: bool = True, mode: str = "overwrite") -> None:
    """Write all splits as parquet, one directory per language (and split)."""
    parts = [c for c in (["language"] if by_language else []) + ["split"] if c in df.columns]
    w = df.write.mode(mode)
    if parts:
        w = w.partitionBy(*parts)
    w.parquet(path)


def _partition_values(spark: SparkSession, path: str, column: str) -> set[str] | None:
    """Values of the first partition column from the folder names, without
    reading a file; None when the folder is not partitioned by ``column``."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    names = [s.getPath().getName() for s in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
             if s.isDirectory()]
    found = {unquote(n.split("=", 1)[1]) for n in names if n.startswith(f"{column}=")}
    return found or None


def load_local(spark: SparkSession, path: str, lang: str | None = None, split: str | None = None) -> DataFrame:
    """Read a saved corpus.  The language may be stored under its iso3 id,
    wiki id or BCP-47 tag; the first alias present is used.  The filter is on
    a partition column, so only that language's files are listed and read."""
    df = spark.read.parquet(path)
    if lang is not None:
        if "language" not in df.columns:
            raise ValueError("Saved corpus is not partitioned by language.")
        present = _partition_values(spark, path, "language")
        if present is None:
            present = {r[0] for r in df.select("language").distinct().collect()}
        chosen = next((a for a in aliases(lang) if a in present), None)
        if chosen is None:
            raise ValueError(f"Language {lang} not found under {path}")
        df = df.filter(F.col("language") == chosen)
    if split is not None:
        if "split" not in df.columns:
            raise ValueError("Saved corpus has no splits.")
        df = df.filter(F.col("split") == split)
    return df


def write_weights(spark: SparkSession, weights: DataFrame, path: str, key: str = "language",
                  value: str = "weight") -> None:
    """Write ``{key: weight}`` as one JSON object (the weight-file format)."""
    (weights.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col(key), F.col(value))))).alias("value"))
     .coalesce(1).write.mode("overwrite").text(path))


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    """Read a ``{language: weight}`` JSON file into ``(language, weight)`` rows."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.explode(F.from_json("value", "map<string,double>")).alias("language", "weight"))


def get_doc(df: DataFrame, idx: int | None = None, seed: int | None = None, id_col: str = "id") -> DataFrame:
    """One document by id, or a seeded random one (top-1 by a hash of the id:
    a single pass with a one-row heap per task, no full sort)."""
    if idx is not None:
        return df.filter(F.col(id_col) == F.lit(idx))
    seed = 0 if seed is None else seed
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")))
    return df.withColumn("__k", key).orderBy("__k", id_col).limit(1).drop("__k")


# --- CoNLL-U treebanks ----------------------------------------------------------------
CONLLU_FIELDS = ["id", "form", "lemma", "upos", "xpos", "feats", "head", "deprel", "deps", "misc"]
# Universal POS tags in the reference's label order (fixed values).
UPOS_LABELS = ["NOUN", "PUNCT", "ADP", "NUM", "SYM", "SCONJ", "ADJ", "PART", "DET", "CCONJ",
               "PROPN", "PRON", "X", "_", "ADV", "INTJ", "VERB", "AUX"]


def read_conllu(spark: SparkSession, path: str) -> DataFrame:
    """Read ``*train/dev/test.conllu`` files: one row per sentence with
    ``idx, text, tokens, lemmas, upos, xpos, feats, head, deprel, deps, misc``
    and ``split`` from the file name (or, for a folder of part files, from the
    folder's name).  ``sent_id``/``text`` comments are used when present;
    otherwise ``idx`` is the sentence's number in its file and the text is the
    tokens joined by spaces.  Lines may end in LF or CRLF.  ``_`` as lemma or
    xpos is NULL, and so is the head of ranges (``1-2``) and empty nodes
    (``1.1``), which stay in the token list."""
    raw = (spark.read.option("lineSep", "\n\n").text(path)
           .select("value", F.col("_metadata.file_path").alias("fname"),
                   F.col("_metadata.file_block_start").alias("__block"))
           .withColumn("__row", F.monotonically_increasing_id()))
    # in a CRLF file no two LF stand together: its sentences are still in one value
    parts = F.when(F.contains("value", F.lit("\r")), F.split("value", r"\r?\n\r?\n")).otherwise(F.array("value"))
    blocks = raw.select("fname", "__block", "__row", F.posexplode(parts).alias("__nth", "block")) \
        .withColumn("block", F.replace("block", F.lit("\r"), F.lit(""))).filter(F.trim("block") != "")
    lines = F.filter(F.split("block", "\n"), lambda l: l != "")
    is_comment = lambda l: l.startswith("#")
    # behind a Generate: lines are cut once, not once for each column that is made of them
    cut = blocks.select("fname", "__block", "__row", "__nth", F.explode(F.array(lines)).alias("__lines")).select(
        "fname", "__block", "__row", "__nth", F.filter("__lines", is_comment).alias("__comments"),
        F.explode(F.array(F.filter("__lines", lambda l: ~is_comment(l)))).alias("__toks"))

    def value(l, i):
        # without an array of all fields for each line; a line that has no such field fails as the array does
        here = F.substring_index(F.substring_index(l, "\t", i + 1), "\t", -1)
        return F.when(F.substring_index(l, "\t", i) == l, F.split(l, "\t")[i]).otherwise(here) if i else here

    def field(i):
        if CONLLU_FIELDS[i] in ("lemma", "xpos"):
            return F.transform("__toks", lambda l: F.nullif(value(l, i), F.lit("_")))
        if CONLLU_FIELDS[i] == "head":
            number = lambda l: value(l, 0)
            return F.transform("__toks", lambda l: F.when(number(l).contains("-") | number(l).contains("."), F.lit(None))
                               .otherwise(value(l, i)))
        return F.transform("__toks", lambda l: value(l, i))

    def comment(key):
        hit = F.filter("__comments", lambda c: c.rlike(rf"^#\s*{key}\s*="))
        return F.regexp_replace(F.try_element_at(hit, F.lit(1)), rf"^#\s*{key}\s*=\s*", "")

    forms = field(1)
    part = F.regexp_extract("fname", r"(train|dev|test)[^/]*$", 1)
    folder = F.regexp_extract("fname", r"(train|dev|test)/[^/]*$", 1)
    named = F.when(part != "", part).otherwise(folder)
    split = F.when(named == "dev", "validation").when(named != "", named).otherwise("train")
    labels = F.array(*[F.lit(x) for x in UPOS_LABELS])
    place = ["fname", "__block", "__row", "__nth"]
    read = cut.select(
        *place, comment("sent_id").alias("idx"),
        F.coalesce(comment("text"), F.array_join(forms, " ")).alias("text"),
        forms.alias("tokens"), field(2).alias("lemmas"), field(3).alias("upos"), field(4).alias("xpos"),
        field(5).alias("feats"), field(6).alias("head"), field(7).alias("deprel"),
        field(8).alias("deps"), field(9).alias("misc"), split.alias("split"))
    # Only sentences without an id need their number: places (never texts) are counted, by a window over one file's
    # in the order of the file, and joined to those sentences.
    has_id = F.col("block").rlike(r"(?:^|\n)#[^\S\n]*sent_id[^\S\n]*=")
    places = blocks.select(*place, has_id.alias("__has_id"))
    if places.filter("NOT __has_id").isEmpty():
        out = read
    else:
        number = F.row_number().over(Window.partitionBy("fname").orderBy("__block", "__row", "__nth")).cast("string")
        numbers = places.withColumn("__number", number).filter("NOT __has_id").select(*place, "__number")
        out = read.filter("idx IS NOT NULL").unionByName(
            read.filter("idx IS NULL").drop("idx").join(numbers, place).withColumnRenamed("__number", "idx"))
    out = out.select("idx", *[c for c in read.columns if c not in (*place, "idx")], "fname")
    # class-label ids of the universal POS tags (-1 for a tag outside the label set)
    return out.withColumn("upos_ids", F.transform("upos", lambda u: F.array_position(labels, u).cast("int") - 1))


def write_text_files(df: DataFrame, path: str, text_col: str = "text") -> None:
    df.select(text_col).coalesce(1).write.mode("overwrite").text(path)
