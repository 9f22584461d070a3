"""Queries for sources, adapters, readers/writers and streaming."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from ..operators import splits, stats
from ..operators.metrics import with_tokens
from ..sources import adapters, io
from ..sources.langs import LANGUAGES, language_table
from ..sources.tables import documents_model, read_documents, read_table, table_path
from ..streaming import stream
from . import sqlfrag as S
from .registry import register
from .q_select import TOKD, sql_pass
from ..functions.signals import GOPHER_THRESHOLDS

DOCS = S.DOCS


def docs(spark, sf):
    return read_documents(spark, sf)


# --- stand-in raw sources built from the test tables (schema only; no work of the job) ---
def raw_wiki(spark, sf):
    p = read_table(spark, sf, "pages")
    return p.select(F.col("page_id").alias("id"), "url",
                    F.regexp_extract("html", r"<title>(.*?)</title>", 1).alias("title"), F.col("html").alias("text"))


def raw_c4(spark, sf):
    d = read_table(spark, sf, "documents")
    return d.select("text", F.timestamp_seconds("doc_id").alias("timestamp"),
                    F.concat(F.lit("https://example.org/doc/"), F.col("doc_id").cast("string")).alias("url"))


def raw_pairs(spark, sf):
    """(conv_id, turn, user text, next assistant text) from conversations."""
    c = read_table(spark, sf, "conversations")
    u = c.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("src"))
    a = c.filter(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"),
                                                      F.col("text").alias("tgt"))
    return u.join(a, ["conv_id", "turn"])


PAIRS_SQL = """(SELECT u.conv_id, u.turn, u.text AS src, a.text AS tgt FROM conversations u JOIN conversations a
  ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')"""


def raw_bible(spark, sf):
    return raw_pairs(spark, sf).select(F.col("src").alias("eng"), F.col("tgt").alias("hau"))


def raw_nllb(spark, sf):
    p = raw_pairs(spark, sf)
    even = (F.col("conv_id") % 2) == 0   # two language pairs in one table
    m = F.when(even, F.create_map(F.lit("eng_Latn"), F.col("src"), F.lit("hau_Latn"), F.col("tgt"))) \
        .otherwise(F.create_map(F.lit("fra_Latn"), F.col("src"), F.lit("deu_Latn"), F.col("tgt")))
    return p.select(m.alias("translation"))


@register("adapt_wiki", "SELECT url, html AS text FROM pages")
def q_adapt_wiki(spark, sf):
    return adapters.adapt_wiki(raw_wiki(spark, sf))


@register("adapt_c4", "SELECT text, 'https://example.org/doc/' || doc_id::VARCHAR AS url FROM documents")
def q_adapt_c4(spark, sf):
    return adapters.adapt_c4(raw_c4(spark, sf))


@register("adapt_parallel_bible", f"SELECT tgt AS text FROM {PAIRS_SQL}")
def q_adapt_bible(spark, sf):
    return adapters.adapt_parallel_bible(raw_bible(spark, sf), "hau")


@register("adapt_translation_pairs", f"SELECT tgt AS text FROM {PAIRS_SQL} WHERE conv_id % 2 = 0")
def q_adapt_nllb(spark, sf):
    return adapters.adapt_translation_pairs(raw_nllb(spark, sf), "hau")


@register("adapt_fineweb", f"SELECT text FROM {DOCS} WHERE language = 'fra'")
def q_adapt_fineweb(spark, sf):
    d = read_table(spark, sf, "documents")
    crawl = documents_model(d).select("text", F.concat(F.col("language"), F.lit("_Latn")).alias("subset"))
    return adapters.adapt_fineweb(crawl, "fra")


@register("load_sources", """
SELECT url, html AS text, 'wiki' AS source FROM pages
UNION ALL SELECT 'https://example.org/doc/' || doc_id::VARCHAR AS url, text, 'mc4' AS source FROM documents""")
def q_load_sources(spark, sf):
    return adapters.load_sources({"wiki": raw_wiki(spark, sf), "mc4": raw_c4(spark, sf),
                                  "unknown_src": raw_c4(spark, sf)}, "hau").select("url", "text", "source")


@register("from_table", "SELECT page_id AS id, html AS text, 'pages' AS source FROM pages")
def q_from_table(spark, sf):
    p = read_table(spark, sf, "pages").select(F.col("page_id").alias("id"), "html")
    return adapters.from_table(p, text_column="html", source="pages")


@register("from_table_multilingual", "SELECT doc_id AS id, text, lang AS language, 'table' AS source FROM documents")
def q_from_table_multi(spark, sf):
    d = read_table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", "lang")
    return adapters.from_table(d, source="table", language_column="lang")


def _scratch(spark, name):
    return stream.scratch_path(spark, name)


@register("save_corpus", f"""
SELECT id, language, CASE WHEN rn <= ceil(0.1 * n) THEN 'test' ELSE 'train' END AS split FROM (
  SELECT id, language, row_number() OVER (ORDER BY ('0x' || substr(md5('42:' || id::VARCHAR), 1, 13))::BIGINT::DOUBLE, id) AS rn,
         count(*) OVER () AS n FROM {DOCS})""")
def q_save_corpus(spark, sf):
    path = _scratch(spark, "corpus")
    io.save_corpus(splits.train_test_split(docs(spark, sf), 0.1), path)
    return spark.read.parquet(path).select("id", "language", "split")


@register("load_local", f"SELECT id, text FROM {DOCS} WHERE language = 'eng'")
def q_load_local(spark, sf):
    path = _scratch(spark, "corpus")
    io.save_corpus(docs(spark, sf), path)
    return io.load_local(spark, path, "en").select("id", "text")


def _reg_sql(field_idx: int, name: str) -> str:
    whens = " ".join(f"WHEN '{r[0]}' THEN '{r[field_idx]}'" for r in LANGUAGES)
    return f"(CASE language {whens} END) AS {name}"


@register("language_registry", f"""
SELECT language, {_reg_sql(1, 'language_name')}, {_reg_sql(2, 'bcp_47')}, count(*)::BIGINT AS docs
FROM {DOCS} GROUP BY language""")
def q_registry(spark, sf):
    reg = language_table(spark).select(F.col("id").alias("language"), F.col("language").alias("language_name"),
                                       "bcp_47")
    st = stats.corpus_stats(docs(spark, sf)).select("language", "docs")
    # the registry is a fixed, small dimension: broadcast
    return st.join(F.broadcast(reg), "language", "left").select("language", "language_name", "bcp_47", "docs")


@register("read_weights", f"SELECT language, count(*)::DOUBLE AS weight FROM {DOCS} GROUP BY language")
def q_read_weights(spark, sf):
    path = _scratch(spark, "weights")
    w = stats.corpus_stats(docs(spark, sf)).select("language", F.col("docs").alias("weight"))
    io.write_weights(spark, w, path)
    return io.read_weights(spark, path)


@register("get_doc", f"SELECT id, text FROM {DOCS} WHERE id = 42")
def q_get_doc(spark, sf):
    return io.get_doc(docs(spark, sf), idx=42).select("id", "text")


@register("get_doc_random", f"SELECT id, text FROM {DOCS} ORDER BY md5('7:' || id::VARCHAR), id LIMIT 1")
def q_get_doc_random(spark, sf):
    return io.get_doc(docs(spark, sf), seed=7).select("id", "text")


@register("read_conllu", f"""
SELECT id::VARCHAR AS idx, md5(array_to_string(tokens, ' ')) AS text_md5, len(tokens)::BIGINT AS n_tokens,
       md5(array_to_string(tokens, chr(10))) AS tokens_md5, len(tokens)::BIGINT AS n_null_lemmas,
       repeat('0', len(tokens)) AS heads, 'train' AS split FROM {TOKD} WHERE len(tokens) > 0""")
def q_read_conllu(spark, sf):
    """CoNLL-U files written from every document (one sentence per document,
    one token per line), read back into the treebank row format."""
    d = with_tokens(docs(spark, sf).select("id", "text")).select("id", "tokens")
    body = F.array_join(F.transform("tokens", lambda t, i: F.concat(
        (i + 1).cast("string"), F.lit("\t"), t, F.lit("\t_\tX\t_\t_\t0\tdep\t_\t_"))), "\n")
    block = F.concat(F.lit("# sent_id = "), F.col("id").cast("string"), F.lit("\n"), body)
    base = _scratch(spark, "ud")
    d.filter(F.size("tokens") > 0).select(block.alias("value")).write.mode("overwrite") \
        .option("lineSep", "\n\n").text(os.path.join(base, "xx-ud-train"))
    t = io.read_conllu(spark, os.path.join(base, "*"))
    return t.select("idx", F.md5("text").alias("text_md5"), F.size("tokens").cast("long").alias("n_tokens"),
                    F.md5(F.array_join("tokens", "\n")).alias("tokens_md5"),
                    F.size(F.filter("lemmas", lambda x: x.isNull())).cast("long").alias("n_null_lemmas"),
                    F.array_join("head", "").alias("heads"), "split")


# --- streaming ----------------------------------------------------------------------
def _doc_stream(spark, sf):
    schema = read_table(spark, sf, "documents").schema
    return documents_model(stream.read_table_stream(spark, table_path(sf, "documents"), schema))


@register("stream_pre_filter", f"""
SELECT id, text, language, source FROM (
  SELECT id, {S.clean_lines('text', ['Latn'], c4=True)} AS text, language, source FROM {DOCS})
WHERE {S.strip('text')} <> ''""")
def q_stream_pre_filter(spark, sf):
    return stream.run_available_now(stream.stream_pre_filter(_doc_stream(spark, sf), ["Latn"], c4=True),
                                    "stream_pre_filter")


@register("stream_threshold", f"SELECT id, text FROM {TOKD} WHERE {sql_pass(GOPHER_THRESHOLDS)}")
def q_stream_threshold(spark, sf):
    out = stream.run_available_now(stream.stream_threshold(_doc_stream(spark, sf), GOPHER_THRESHOLDS),
                                   "stream_threshold")
    return out.select("id", "text")


@register("stream_dedup_exact", f"SELECT DISTINCT md5(array_to_string(tokens, '')) AS exact_hash FROM {TOKD}")
def q_stream_dedup(spark, sf):
    out = stream.run_available_now(stream.stream_dedup_exact(_doc_stream(spark, sf)), "stream_dedup")
    return out.select("exact_hash")


@register("stream_dedup_table", f"SELECT DISTINCT md5(array_to_string(tokens, '')) AS exact_hash FROM {TOKD}")
def q_stream_dedup_table(spark, sf):
    """Exact dedup of a stream without streaming state."""
    return stream.dedup_exact_to_table(_doc_stream(spark, sf), stream.scratch_path(spark, "stream_dedup_table")) \
        .select("exact_hash")


@register("to_stream_to_table", f"SELECT id, text, language, source FROM {DOCS}")
def q_to_stream(spark, sf):
    return stream.to_table(stream.to_stream(docs(spark, sf)), "roundtrip")


@register("stream_corpus_stats", f"""
SELECT language, count(*)::BIGINT AS docs, sum(length(text))::BIGINT AS chars FROM {DOCS} GROUP BY language""")
def q_stream_stats(spark, sf):
    return stream.run_available_now(stream.stream_corpus_stats(_doc_stream(spark, sf)), "stream_stats",
                                    output_mode="complete")
