"""Queries for tokenizer vocabulary work, training-sequence tables,
evaluation scores, the perplexity signal and language identification."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import tokenize
from ..operators import encoders, evaluate, lm, prep, unigram, vocab
from ..operators.metrics import with_tokens
from ..operators.rowindex import group_row_index
from ..sources.tables import read_documents, read_table
from . import sqlfrag as S
from .registry import register
from .q_io import PAIRS_SQL, raw_pairs

DOCS = S.DOCS
TOKD = f"(SELECT *, {S.tok('text')} AS tokens FROM {DOCS})"
V = 30000


def docs(spark, sf):
    return read_documents(spark, sf)


# Stand-in token ids for the sequence tables: a hashed word-level id
# (4 + first 6 hex digits of md5(token) mod 30000; ids 0-3 are reserved).
def hashed_ids(tokens):
    return F.transform(tokens, lambda t: (F.lit(4) + F.conv(F.substring(F.md5(t), 1, 6), 16, 10).cast("long")
                                          % F.lit(V)).cast("long"))


SQL_IDS = f"list_transform(tokens, lambda t: 4 + ('0x' || substr(md5(t), 1, 6))::BIGINT % {V})"
IDS_SQL = f"(SELECT id, {SQL_IDS} AS ids FROM {TOKD})"


def encoded(spark, sf):
    return with_tokens(docs(spark, sf)).select("id", hashed_ids(F.col("tokens")).alias("input_ids"))


L = 64
CHUNKS_SQL = f"""(SELECT id, chunk, ids[chunk * {L} + 1 : chunk * {L} + {L}] AS ids FROM (
  SELECT id, ids, unnest(range(0, greatest(ceil(len(ids) / {L}.0)::BIGINT, 1))) AS chunk FROM {IDS_SQL}))"""


@register("chunk_sequences", f"""
SELECT id, chunk, len(ids)::BIGINT AS n_ids, md5(array_to_string(ids, ',')) AS ids_md5 FROM {CHUNKS_SQL}""")
def q_chunk(spark, sf):
    c = prep.chunk_sequences(encoded(spark, sf), L)
    return c.select("id", F.col("chunk").cast("long").alias("chunk"), F.size("input_ids").cast("long").alias("n_ids"),
                    F.md5(F.array_join("input_ids", ",")).alias("ids_md5"))


def _u_sql(tag, seed=0):
    return (f"(('0x' || substr(md5(concat_ws(':', '{seed}', '{tag}', id::VARCHAR, chunk::VARCHAR, (i - 1)::VARCHAR)), 1, 13))"
            f"::BIGINT::DOUBLE / {float(1 << 52)})")


_SEL = f"({_u_sql('sel')} < 0.15 AND x NOT IN (0, 1, 2, 3))"


@register("mask_tokens", f"""
SELECT id, chunk,
  md5(array_to_string(list_transform(ids, lambda x, i: CASE WHEN {_SEL} THEN x ELSE -100 END), ',')) AS labels_md5,
  md5(array_to_string(list_transform(ids, lambda x, i: CASE WHEN NOT {_SEL} THEN x WHEN {_u_sql('how')} < 0.8 THEN 5
      WHEN {_u_sql('how')} < 0.9 THEN (4 + floor({_u_sql('tok')} * {V - 4}))::BIGINT ELSE x END), ',')) AS inputs_md5
FROM {CHUNKS_SQL}""")
def q_mask(spark, sf):
    c = prep.chunk_sequences(encoded(spark, sf), L)
    m = prep.mask_tokens(c, mask_id=5, vocab_size=V, mask_prob=0.15, seed=0)
    return m.select("id", F.col("chunk").cast("long").alias("chunk"),
                    F.md5(F.array_join("labels", ",")).alias("labels_md5"),
                    F.md5(F.array_join("input_ids", ",")).alias("inputs_md5"))


_P8 = "(ceil(len(ids) / 8.0) * 8)::BIGINT"


@register("pad_sequences", f"""
SELECT id, chunk, md5(array_to_string(list_resize(ids, {_P8}, 0), ',')) AS ids_md5,
       md5(array_to_string(list_resize(list_transform(ids, lambda x: 1), {_P8}, 0), ',')) AS mask_md5 FROM {CHUNKS_SQL}""")
def q_pad(spark, sf):
    p = prep.pad_sequences(prep.chunk_sequences(encoded(spark, sf), L), pad_id=0, multiple_of=8)
    return p.select("id", F.col("chunk").cast("long").alias("chunk"),
                    F.md5(F.array_join("input_ids", ",")).alias("ids_md5"),
                    F.md5(F.array_join("attention_mask", ",")).alias("mask_md5"))


@register("causal_labels", f"""
SELECT id, chunk, md5(array_to_string(list_resize(ids, {_P8}, -100), ',')) AS labels_md5 FROM {CHUNKS_SQL}""")
def q_causal(spark, sf):
    p = prep.causal_labels(prep.pad_sequences(prep.chunk_sequences(encoded(spark, sf), L), 0, multiple_of=8))
    return p.select("id", F.col("chunk").cast("long").alias("chunk"),
                    F.md5(F.array_join("labels", ",")).alias("labels_md5"))


@register("special_token_frame", f"""
SELECT id, (len(ids) + 2)::BIGINT AS n_ids, md5(array_to_string(list_concat([2], ids, [3]), ',')) AS ids_md5,
       2::BIGINT AS n_special FROM {IDS_SQL}""")
def q_special_frame(spark, sf):
    f = prep.special_token_frame(encoded(spark, sf))
    return f.select("id", F.size("input_ids").cast("long").alias("n_ids"),
                    F.md5(F.array_join("input_ids", ",")).alias("ids_md5"),
                    F.aggregate("special_tokens_mask", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_special"))


@register("pair_inputs", f"""
WITH p AS (SELECT conv_id, turn, {S.tok('src')} AS ta, {S.tok('tgt')} AS tb FROM {PAIRS_SQL}),
e AS (SELECT conv_id, turn, list_transform(ta, lambda t: 4 + ('0x' || substr(md5(t), 1, 6))::BIGINT % {V}) AS a,
             list_transform(tb, lambda t: 4 + ('0x' || substr(md5(t), 1, 6))::BIGINT % {V}) AS b FROM p)
SELECT conv_id, turn, md5(array_to_string(list_concat([2], a, [3], b, [3]), ',')) AS ids_md5,
       (len(b) + 1)::BIGINT AS n_second FROM e""")
def q_pair_inputs(spark, sf):
    p = raw_pairs(spark, sf).select("conv_id", "turn", hashed_ids(tokenize("src")).alias("a"),
                                    hashed_ids(tokenize("tgt")).alias("b"))
    out = prep.pair_inputs(p, "a", "b")
    return out.select("conv_id", "turn", F.md5(F.array_join("input_ids", ",")).alias("ids_md5"),
                      F.aggregate("token_type_ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_second"))


def _word_frame(spark, sf):
    """Words -> sub-token word ids (4-character pieces) and a tag per word
    (0 letter-initial, 1 punctuation, 2 other); markers at both ends."""
    t = with_tokens(docs(spark, sf)).select("id", "tokens")
    wid = F.flatten(F.transform("tokens", lambda w, i: F.array_repeat(i.cast("long"),
                                                                      F.ceil(F.length(w) / 4).cast("int"))))
    wid = F.concat(F.array(F.lit(-1).cast("long")), wid, F.array(F.lit(-1).cast("long")))
    tags = F.transform("tokens", lambda w: F.when(w.rlike(r"^\p{L}"), 0).when(w.rlike(r"^\p{P}"), 1).otherwise(2))
    return t.select("id", "tokens", wid.alias("word_ids"), tags.alias("tags"))


_TAG_SQL = "CASE WHEN regexp_matches(w, '^\\p{L}') THEN 0 WHEN regexp_matches(w, '^\\p{P}') THEN 1 ELSE 2 END"


def _spread_sql(value: str) -> str:
    """A value on the first sub-token of each word, -100 on the others and on
    the markers at both ends."""
    return (f"list_concat([-100::BIGINT], flatten(list_transform(tokens, lambda w, i: list_concat([({value})::BIGINT], "
            f"list_resize([]::BIGINT[], (ceil(length(w) / 4.0) - 1)::BIGINT, -100)))), [-100::BIGINT])")


@register("align_word_labels", f"""
SELECT id, len(tokens)::BIGINT AS n_labelled, md5(array_to_string({_spread_sql(_TAG_SQL)}, ',')) AS labels_md5 FROM {TOKD}""")
def q_align_words(spark, sf):
    """First sub-token of each word carries the word's tag; others -100."""
    a = prep.align_word_labels(_word_frame(spark, sf))
    return a.select("id", F.size(F.filter("labels", lambda x: x != -100)).cast("long").alias("n_labelled"),
                    F.md5(F.array_join("labels", ",")).alias("labels_md5"))


@register("align_dependency_labels", f"""
SELECT id, md5(array_to_string(h, ',')) AS heads_md5, md5(array_to_string(r, ',')) AS rels_md5,
  md5(array_to_string(list_resize(list_filter(list_transform(h, lambda x, i: CASE WHEN x <> -100 THEN i - 1 ELSE -1 END),
                                              lambda x: x >= 0), 129, -100), ',')) AS starts_md5
FROM (SELECT id, ({_spread_sql('i - 1')})[1:128] AS h, ({_spread_sql(_TAG_SQL)})[1:128] AS r FROM {TOKD})""")
def q_align_dep(spark, sf):
    """Heads (previous word), relation ids and word starts of sequences of at
    most 128 sub-tokens."""
    w = _word_frame(spark, sf)
    w = w.withColumn("head", F.transform("tokens", lambda x, i: i.cast("long"))) \
        .withColumn("deprel_ids", F.col("tags"))
    a = prep.align_dependency_labels(w, 128)
    return a.select("id", F.md5(F.array_join("labels_head", ",")).alias("heads_md5"),
                    F.md5(F.array_join("labels_rel", ",")).alias("rels_md5"),
                    F.md5(F.array_join("word_starts", ",")).alias("starts_md5"))


# --- evaluation ----------------------------------------------------------------------
@register("weighted_precision_recall", """
WITH d AS (SELECT quality AS t, toxic AS p FROM labels),
cls AS (SELECT t AS c FROM d UNION SELECT p FROM d),
per AS (SELECT c, (SELECT count(*) FROM d WHERE t = c) AS sup, (SELECT count(*) FROM d WHERE p = c) AS pc,
               (SELECT count(*) FROM d WHERE t = c AND p = c) AS tp FROM cls),
a AS (SELECT sum(CASE WHEN pc > 0 THEN tp / pc ELSE 0 END * sup) / sum(sup) AS pr,
             sum(CASE WHEN sup > 0 THEN tp / sup ELSE 0 END * sup) / sum(sup) AS re FROM per)
SELECT round(pr, 6) AS precision, round(re, 6) AS recall,
       round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END, 6) AS f1 FROM a""")
def q_weighted_pr(spark, sf):
    lab = read_table(spark, sf, "labels").select(F.col("quality").alias("label"), F.col("toxic").alias("pred"))
    return evaluate.weighted_precision_recall(lab)


def _bio(tokens, min_len):
    """BIO tags: runs of capitalised words of length >= min_len are entities."""
    cap = F.transform(tokens, lambda w: w.rlike(r"^\p{Lu}") & (F.length(w) >= min_len))
    prev = F.concat(F.array(F.lit(False)), F.slice(cap, 1, F.greatest(F.size(cap) - 1, F.lit(0))))
    return F.zip_with(cap, prev, lambda c, p: F.when(~c, "O").when(p, "I-ENT").otherwise("B-ENT"))


def _spans_sql(min_len: int) -> str:
    return (f"(SELECT id, min(i) AS a, max(i) AS b FROM (SELECT id, i, i - row_number() OVER (PARTITION BY id ORDER BY i) AS run "
            f"FROM (SELECT id, unnest(tokens) AS w, unnest(range(len(tokens))) AS i FROM {TOKD}) "
            f"WHERE regexp_matches(w, '^\\p{{Lu}}') AND length(w) >= {min_len}) GROUP BY id, run)")


@register("entity_span_f1", f"""
WITH g AS {_spans_sql(1)}, p AS {_spans_sql(4)},
n AS (SELECT (SELECT count(*) FROM g JOIN p USING (id, a, b)) AS tp, (SELECT count(*) FROM p) AS np, (SELECT count(*) FROM g) AS ng),
s AS (SELECT tp / np AS pr, tp / ng AS re FROM n)
SELECT round(pr, 6) AS precision, round(re, 6) AS recall, round(2 * pr * re / (pr + re), 6) AS f1 FROM s""")
def q_span_f1(spark, sf):
    """Gold: runs of capitalised words; prediction: the same with length >= 4."""
    t = with_tokens(docs(spark, sf)).select("id", _bio(F.col("tokens"), 1).alias("gold_tags"),
                                            _bio(F.col("tokens"), 4).alias("pred_tags"))
    return evaluate.entity_span_f1(t)


@register("attachment_scores", f"""
WITH w AS (SELECT unnest(tokens) AS w, unnest(range(len(tokens))) AS i FROM {TOKD})
SELECT round(avg(CASE WHEN gh = ph THEN 1.0 ELSE 0.0 END) * 100, 6) AS uas,
       round(avg(CASE WHEN gh = ph AND gr = pr THEN 1.0 ELSE 0.0 END) * 100, 6) AS las FROM (
  SELECT i AS gh, CASE WHEN length(w) > 3 THEN i ELSE 0 END AS ph,
         CASE WHEN regexp_matches(w, '^\\p{{L}}') THEN 0 WHEN regexp_matches(w, '^\\p{{P}}') THEN 1 ELSE 2 END AS gr,
         CASE WHEN length(w) > 5 THEN CASE WHEN regexp_matches(w, '^\\p{{L}}') THEN 0
              WHEN regexp_matches(w, '^\\p{{P}}') THEN 1 ELSE 2 END ELSE 9 END AS pr FROM w)""")
def q_attachment(spark, sf):
    w = _word_frame(spark, sf)
    gh = F.transform("tokens", lambda x, i: i.cast("long"))
    ph = F.transform("tokens", lambda x, i: F.when(F.length(x) > 3, i.cast("long")).otherwise(F.lit(0).cast("long")))
    pr = F.zip_with("tokens", "tags", lambda x, t: F.when(F.length(x) > 5, t).otherwise(F.lit(9)))
    t = w.select(gh.alias("gh"), ph.alias("ph"), F.col("tags").alias("gr"), pr.alias("pr"))
    return evaluate.attachment_scores(t, "gh", "ph", "gr", "pr")


def _loss_sql(train: str) -> str:
    """Trigram back-off losses of all documents; the model counts ``train``."""
    grams = ("SELECT id, k[i] AS u, k[i + 1] AS v, k[i + 2] AS w FROM (SELECT id, k, unnest(range(1, len(k) - 1)) AS i FROM "
             "(SELECT id, list_concat(['<s>', '<s>'], tokens) AS k FROM {}))")
    return f"""
g AS ({grams.format(TOKD)}), tg AS ({grams.format(train)}),
tri AS (SELECT u, v, w, count(*) AS c FROM tg GROUP BY ALL), p3 AS (SELECT u, v, w, c / sum(c) OVER (PARTITION BY u, v) AS p3 FROM tri),
bi AS (SELECT v, w, sum(c) AS c FROM tri GROUP BY ALL), p2 AS (SELECT v, w, c / sum(c) OVER (PARTITION BY v) AS p2 FROM bi),
uni AS (SELECT w, sum(c) AS c FROM tri GROUP BY w), z AS (SELECT sum(c) + count(*) + 1 AS z FROM uni),
p1 AS (SELECT w, (c + 1) / z AS p1 FROM uni, z),
loss AS (SELECT id, avg(-ln(coalesce(p3, p2 * 0.4, coalesce(p1, 1.0 / z) * 0.4 * 0.4))) AS loss
         FROM g LEFT JOIN p3 USING (u, v, w) LEFT JOIN p2 USING (v, w) LEFT JOIN p1 USING (w), z GROUP BY id)"""


_TRAIN_SQL = f"""(SELECT * FROM {TOKD} WHERE id IN (SELECT id FROM (SELECT id, count(*) OVER () AS n, row_number() OVER
  (ORDER BY ('0x' || substr(md5('42:' || id::VARCHAR), 1, 13))::BIGINT::DOUBLE, id) AS rn FROM {DOCS}) WHERE rn > ceil(0.5 * n)))"""


@register("loss_to_perplexity", f"""
WITH {_loss_sql(TOKD)} SELECT round(avg(loss), 6) AS loss, round(exp(avg(loss)), 6) AS perplexity FROM loss""")
def q_loss_ppl(spark, sf):
    """Mean per-document trigram-LM loss (trained on the corpus) and exp(mean)."""
    d = docs(spark, sf)
    return evaluate.loss_to_perplexity(lm.token_losses(d, lm.train_trigram_lm(d)))


@register("perplexity", f"""
WITH {_loss_sql(_TRAIN_SQL)},
ppl AS (SELECT d.id, exp(coalesce(loss, 0.0)) AS p FROM {DOCS} d LEFT JOIN loss USING (id))
SELECT id, round(abs(p - median(p) OVER ()), 2) AS perplexity FROM ppl""")
def q_perplexity(spark, sf):
    """|ppl - median ppl| of all documents under a trigram LM with back-off,
    counted on the train half of a split."""
    from ..operators import splits
    d = docs(spark, sf)
    train = splits.train_test_split(d, 0.5, seed=42).filter("split = 'train'")
    return lm.perplexity_signal(d, train).select("id", F.round("perplexity", 2).alias("perplexity"))


@register("train_lang_profiles", f"""
WITH g AS (SELECT language, unnest({S.ngrams(S.chars('lower(text)'), 3)}) AS gram FROM {DOCS}),
c AS (SELECT language, gram, count(*) AS c FROM g GROUP BY ALL),
t AS (SELECT language, sum(c) AS tot, count(*) AS types FROM c GROUP BY language)
SELECT language, gram, round(ln((c + 1.0) / (tot + types + 1)), 6) AS logp FROM c JOIN t USING (language)""")
def q_lang_profiles(spark, sf):
    return lm.train_lang_profiles(docs(spark, sf)).select("language", "gram", F.round("logp", 6).alias("logp"))


@register("lang_id_filter", f"""
WITH pg AS (SELECT language, unnest({S.ngrams(S.chars('lower(text)'), 3)}) AS gram FROM {DOCS}),
pc AS (SELECT language, gram, count(*) AS c FROM pg GROUP BY ALL),
pt AS (SELECT language, sum(c) + count(*) + 1 AS z FROM pc GROUP BY language),
prof AS (SELECT language, gram, ln((c + 1.0) / z) AS logp FROM pc JOIN pt USING (language)),
fl AS (SELECT language, min(logp) AS floor FROM prof GROUP BY language),
l AS (SELECT id, i, ls[i] AS line FROM (SELECT id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (
  SELECT id, string_split(t, chr(10)) AS ls FROM (SELECT id, {S.clean_lines('text', None)} AS t FROM {DOCS}) WHERE t <> ''))),
g AS (SELECT id, i, gram, count(*) AS c FROM (SELECT id, i, unnest({S.ngrams(S.chars('lower(line)'), 3)}) AS gram FROM l) GROUP BY ALL),
n AS (SELECT id, i, sum(c) AS ng FROM g GROUP BY ALL),
sc AS (SELECT id, i, language, sum(c * (logp - floor)) AS gain, any_value(floor) AS floor
       FROM g JOIN prof USING (gram) JOIN fl USING (language) GROUP BY ALL),
best AS (SELECT id, i, arg_max(language, gain + ng * floor) AS pred FROM sc JOIN n USING (id, i) GROUP BY ALL)
SELECT id, string_agg(line, chr(10) ORDER BY i) AS text FROM l LEFT JOIN best USING (id, i)
WHERE pred = 'eng' OR length(line) < 3 GROUP BY id""")
def q_lang_id(spark, sf):
    """Keep English lines only, by char-trigram profiles trained on the corpus."""
    d = docs(spark, sf)
    return lm.lang_id_filter(d, lm.train_lang_profiles(d), ["eng"]).select("id", "text")


# --- vocabulary ------------------------------------------------------------------------
@register("normalize_text", f"SELECT id, lower(nfc_normalize(text)) AS text FROM {DOCS}")
def q_normalize(spark, sf):
    return docs(spark, sf).select("id", vocab.normalize_text(F.col("text"), ["nfc", "lowercase"]).alias("text"))


_WS = f"[{S.SQL_SPACE}]"
_PRE_SQL = (f"flatten(list_transform(regexp_extract_all(text, '[\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Nl}}\\p{{Pc}}]+|"
            f"[^\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Nl}}\\p{{Pc}}{S.SQL_SPACE}]+'), "
            f"lambda p: regexp_extract_all(p, '\\p{{Nd}}|[^\\p{{Nd}}]+')))")


@register("pretokenize", f"""
SELECT id, len({_PRE_SQL})::BIGINT AS n_pieces, md5(array_to_string({_PRE_SQL}, ' ')) AS pieces_md5 FROM {DOCS}""")
def q_pretokenize(spark, sf):
    p = vocab.pretokenize(F.col("text"), ["whitespace", "digits"])
    return docs(spark, sf).select("id", F.size(p).cast("long").alias("n_pieces"),
                                  F.md5(F.array_join(p, " ")).alias("pieces_md5"))


@register("word_frequencies", f"""
SELECT word, count(*)::BIGINT AS count FROM (SELECT unnest({_PRE_SQL}) AS word FROM {DOCS}) GROUP BY word""")
def q_word_freq(spark, sf):
    return vocab.word_frequencies(docs(spark, sf), pre=["whitespace", "digits"])


#: Sizes of the registered vocabularies: merges beyond the characters (a round of them is one Spark job, see
#: README), and pieces.
MERGES = 1_000
UNIGRAM_PIECES = 8_000
SPECIALS = list(vocab.DEFAULT_SPECIALS.values())


def _trained(d, prefix=""):
    """A vocabulary of the characters of ``d`` and ``MERGES`` merges."""
    words = vocab.word_frequencies(d).checkpoint()
    size = len(SPECIALS) + len(vocab.word_characters(words, prefix)) + MERGES
    return vocab.train_bpe(words, size, continuing_prefix=prefix)


@register("train_bpe")
def q_train_bpe(spark, sf):
    """BPE vocabulary of 1 000 merges from the corpus' word frequencies."""
    return _trained(docs(spark, sf))[0]


@register("train_wordpiece")
def q_train_wordpiece(spark, sf):
    """WordPiece-style vocabulary (## continuation prefix) of 1 000 merges."""
    return _trained(docs(spark, sf), "##")[0]


@register("train_unigram")
def q_train_unigram(spark, sf):
    """Unigram-LM vocabulary of 8 000 pieces (all frequent substrings, soft EM, pruning by loss)."""
    return unigram.train_unigram(vocab.word_frequencies(docs(spark, sf)), UNIGRAM_PIECES)


def _ids(encoded):
    return encoded.select("id", F.size("input_ids").cast("long").alias("n_ids"),
                          F.md5(F.array_join("input_ids", ",")).alias("ids_md5"))


@register("encode_unigram")
def q_encode_unigram(spark, sf):
    """Encode every document with the most probable pieces of a unigram vocabulary trained on the corpus."""
    d = docs(spark, sf)
    v = unigram.train_unigram(vocab.word_frequencies(d), UNIGRAM_PIECES)
    return _ids(encoders.encode_unigram(d, v, specials=SPECIALS))


@register("encode_wordpiece")
def q_encode_wordpiece(spark, sf):
    """Encode every document by longest match with a WordPiece vocabulary trained on the corpus."""
    d = docs(spark, sf)
    v, _ = _trained(d, "##")
    return _ids(encoders.encode_wordpiece(d, v, specials=SPECIALS))


@register("encode_corpus")
def q_encode(spark, sf):
    """Encode every document with a BPE vocabulary trained on the corpus."""
    d = docs(spark, sf)
    v, merges = _trained(d)
    return _ids(vocab.encode_corpus(d, merges, v))


def _ranked_words(spark, table_df, offset):
    wf = vocab.word_frequencies(table_df)
    r = group_row_index(wf.withColumn("neg", -F.col("count")), None, ["neg", "word"], "r")
    return r.select(F.col("word").alias("piece"), (F.col("r") + offset).alias("id"))


def _wf(table: str) -> str:
    w = "\\p{L}\\p{M}\\p{Nd}\\p{Nl}\\p{Pc}"
    return (f"(SELECT word, count(*) AS c FROM (SELECT unnest(regexp_extract_all(text, '[{w}]+|[^{w}{S.SQL_SPACE}]+'))"
            f" AS word FROM {table}) GROUP BY word)")


@register("merge_vocabularies", f"""
WITH a AS (SELECT word AS piece, (row_number() OVER (ORDER BY c DESC, word) - 1 + 4)::BIGINT AS id
           FROM {_wf('documents')}),
b AS (SELECT word AS piece, (row_number() OVER (ORDER BY c DESC, word) - 1)::BIGINT AS id
      FROM {_wf('benchmark')}),
m AS (SELECT piece, id FROM b WHERE piece NOT IN (SELECT piece FROM a)),
top AS (SELECT max(id) AS mx FROM a)
SELECT piece, id FROM a
UNION ALL SELECT piece, (dense_rank() OVER (ORDER BY id, piece) + top.mx)::BIGINT AS id FROM m, top""")
def q_merge_vocab(spark, sf):
    a = _ranked_words(spark, read_table(spark, sf, "documents"), 4)
    b = _ranked_words(spark, read_table(spark, sf, "benchmark"), 0)
    return vocab.merge_vocabularies(a, b)


@register("special_tokens", f"""
WITH w AS (SELECT word AS piece, (row_number() OVER (ORDER BY c DESC, word) - 1 + 5)::BIGINT AS id
           FROM {_wf('documents')})
SELECT piece, id FROM (VALUES ('<pad>', 0::BIGINT), ('<unk>', 1::BIGINT), ('<s>', 2::BIGINT), ('</s>', 3::BIGINT),
                              ('<mask>', 4::BIGINT)) AS t(piece, id)
UNION ALL SELECT piece, id FROM w""")
def q_special_tokens(spark, sf):
    """Reserved special-token rows (pad 0, unk 1, bos 2, eos 3, then the
    user-defined mask token) in front of the corpus' word vocabulary."""
    sp = vocab.special_tokens_table(spark, {"mask_token": "<mask>"}).select("piece", "id")
    n = sp.count()
    words = _ranked_words(spark, read_table(spark, sf, "documents"), n)
    return sp.unionByName(words)
