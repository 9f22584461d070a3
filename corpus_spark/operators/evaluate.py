"""Evaluation tables: classification, span and dependency scores, and
perplexity from losses.  Each is a small number of aggregates; nothing is
collected row by row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def weighted_precision_recall(df: DataFrame, y_true: str = "label", y_pred: str = "pred") -> DataFrame:
    """Support-weighted precision and recall over classes (a class with no
    predictions has precision 0); F1 is the harmonic mean of the two weighted
    scores (as the reference computes it, not the weighted mean of F1s)."""
    per = (df.select(F.col(y_true).alias("t"), F.col(y_pred).alias("p"))
           .select(F.explode(F.array(
               F.struct(F.col("t").alias("c"), F.lit(1).alias("sup"), F.lit(0).alias("pc"),
                        (F.col("t") == F.col("p")).cast("int").alias("tp")),
               F.struct(F.col("p").alias("c"), F.lit(0).alias("sup"), F.lit(1).alias("pc"),
                        F.lit(0).alias("tp")))).alias("s"))
           .groupBy(F.col("s.c").alias("c"))
           .agg(F.sum("s.sup").alias("sup"), F.sum("s.pc").alias("pc"), F.sum("s.tp").alias("tp")))
    prec = F.when(F.col("pc") > 0, F.col("tp") / F.col("pc")).otherwise(F.lit(0.0))
    rec = F.when(F.col("sup") > 0, F.col("tp") / F.col("sup")).otherwise(F.lit(0.0))
    agg = per.agg((F.sum(prec * F.col("sup")) / F.sum("sup")).alias("precision"),
                  (F.sum(rec * F.col("sup")) / F.sum("sup")).alias("recall"))
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))) \
        .otherwise(F.lit(0.0))
    return agg.select(F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"),
                      F.round(f1, 6).alias("f1"))


def bio_spans(tags) -> "F.Column":
    """Spans ``(start, end, type)`` of a BIO tag array (per row, no shuffle).
    A span starts at B-x, or at I-x that does not continue a span of type x."""
    prev = F.concat(F.array(F.lit("O")), F.slice(tags, 1, F.greatest(F.size(tags) - 1, F.lit(0))))
    typ = lambda t: F.regexp_extract(t, r"^[BI]-(.*)$", 1)
    begins = F.zip_with(tags, prev, lambda t, p: t.startswith("B-") | (t.startswith("I-") & (typ(p) != typ(t))))
    starts = F.filter(F.transform(begins, lambda b, i: F.when(b, i).otherwise(F.lit(-1))), lambda x: x >= 0)
    # the span of a start runs while the following tags are I- of the same type
    cont = F.zip_with(F.concat(F.slice(tags, 2, F.greatest(F.size(tags) - 1, F.lit(0))), F.array(F.lit("O"))),
                      tags, lambda nxt, t: nxt.startswith("I-") & (typ(nxt) == typ(t)))
    stops = F.filter(F.transform(cont, lambda c, i: F.when(~c & (F.element_at(tags, i + 1) != "O"), i)
                                 .otherwise(F.lit(-1))), lambda x: x >= 0)
    return F.zip_with(starts, stops, lambda s, e: F.struct(s.alias("start"), e.alias("end"),
                                                          typ(F.element_at(tags, s + 1)).alias("type")))


def entity_span_f1(df: DataFrame, gold: str = "gold_tags", pred: str = "pred_tags", id_col: str = "id") -> DataFrame:
    """Span-level precision / recall / F1 (exact match of start, end and type)."""
    g = df.select(id_col, F.explode(bio_spans(F.col(gold))).alias("s")).select(id_col, "s.*")
    p = df.select(id_col, F.explode(bio_spans(F.col(pred))).alias("s")).select(id_col, "s.*")
    keys = [id_col, "start", "end", "type"]
    j = g.withColumn("g", F.lit(1)).join(p.withColumn("p", F.lit(1)), keys, "full")
    a = j.agg(F.count_if(F.col("g").isNotNull() & F.col("p").isNotNull()).alias("tp"),
              F.count_if(F.col("p").isNotNull()).alias("np"), F.count_if(F.col("g").isNotNull()).alias("ng"))
    prec = F.when(F.col("np") > 0, F.col("tp") / F.col("np")).otherwise(F.lit(0.0))
    rec = F.when(F.col("ng") > 0, F.col("tp") / F.col("ng")).otherwise(F.lit(0.0))
    return a.select(F.round(prec, 6).alias("precision"), F.round(rec, 6).alias("recall"),
                    F.round(F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(F.lit(0.0)), 6)
                    .alias("f1"))


def attachment_scores(df: DataFrame, gold_head: str, pred_head: str, gold_rel: str, pred_rel: str,
                      ignore: int = -100) -> DataFrame:
    """UAS / LAS (x100) over positions whose gold head is not ``ignore``."""
    z = df.select(F.explode(F.arrays_zip(F.col(gold_head).alias("gh"), F.col(pred_head).alias("ph"),
                                         F.col(gold_rel).alias("gr"), F.col(pred_rel).alias("pr"))).alias("z")) \
        .filter(F.col("z.gh") != ignore)
    return z.agg(F.round(F.avg((F.col("z.gh") == F.col("z.ph")).cast("double")) * 100, 6).alias("uas"),
                 F.round(F.avg(((F.col("z.gh") == F.col("z.ph")) & (F.col("z.gr") == F.col("z.pr")))
                               .cast("double")) * 100, 6).alias("las"))


def loss_to_perplexity(df: DataFrame, loss_col: str = "loss") -> DataFrame:
    """Mean loss and its exponential."""
    return df.agg(F.avg(loss_col).alias("loss")).select(F.round("loss", 6).alias("loss"),
                                                       F.round(F.exp("loss"), 6).alias("perplexity"))
