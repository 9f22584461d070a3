"""Distribution comparisons and curve knees: KS and Jensen-Shannon
statistics, the farthest-from-chord elbow, representative sample sizes and
the elbow split of a sorted metric curve.

Running sums over an ordered table use the zipWithIndex-style scheme of
:mod:`.rowindex` (range partitions, per-partition totals, broadcast
offsets), never one global window.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import ensure_checkpoint_dir
from .rowindex import group_row_index


def running_sums(df: DataFrame, order_cols: list[str], value_cols: list[str],
                 num_partitions: int | None = None) -> DataFrame:
    """Add ``cum_<v>``: inclusive running sums in ``order_cols`` order."""
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ensure_checkpoint_dir(spark)
    s = df.repartitionByRange(n, *order_cols).withColumn("__pid", F.spark_partition_id()).checkpoint()
    tot = s.groupBy("__pid").agg(*[F.sum(v).alias(v) for v in value_cols]).collect()
    tot.sort(key=lambda r: r["__pid"])
    run = {v: 0.0 for v in value_cols}
    rows = []
    for r in tot:
        rows.append([r["__pid"]] + [float(run[v]) for v in value_cols])
        for v in value_cols:
            run[v] += float(r[v] or 0)
    offs = spark.createDataFrame(rows, ", ".join(["__pid int"] + [f"off_{v} double" for v in value_cols]))
    # one window per range partition (bounded by the partition size)
    w = Window.partitionBy("__pid").orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, 0)
    out = s.join(F.broadcast(offs), "__pid")
    for v in value_cols:
        out = out.withColumn(f"cum_{v}", F.sum(v).over(w) + F.col(f"off_{v}"))
    return out.drop("__pid", *[f"off_{v}" for v in value_cols])


def ks_statistic(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance: max |F_a(x) - F_b(x)|."""
    u = (a.select(F.col(col).cast("double").alias("v"), F.lit(1.0).alias("ca"), F.lit(0.0).alias("cb"))
         .unionByName(b.select(F.col(col).cast("double").alias("v"), F.lit(0.0).alias("ca"), F.lit(1.0).alias("cb")))
         .filter(F.col("v").isNotNull()))
    per = u.groupBy("v").agg(F.sum("ca").alias("ca"), F.sum("cb").alias("cb"))
    tot = per.agg(F.sum("ca"), F.sum("cb")).first()
    cs = running_sums(per, ["v"], ["ca", "cb"])
    return cs.agg(F.max(F.abs(F.col("cum_ca") / F.lit(tot[0]) - F.col("cum_cb") / F.lit(tot[1]))).alias("ks")) \
        .select(F.round("ks", 6).alias("ks"))


def _hist(df: DataFrame, col: str, bins: int) -> tuple[np.ndarray, float, float]:
    mm = df.agg(F.min(col).cast("double"), F.max(col).cast("double"), F.count(col)).first()
    lo, hi, n = mm[0], mm[1], mm[2]
    width = (hi - lo) / bins if hi > lo else 1.0
    b = F.least(F.floor((F.col(col).cast("double") - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    counts = np.zeros(bins)
    for r in df.filter(F.col(col).isNotNull()).groupBy(b.alias("b")).agg(F.count(F.lit(1)).alias("c")).collect():
        counts[r["b"]] = r["c"]
    return counts, width, float(n)


def js_divergence(a: DataFrame, b: DataFrame, col: str, bins: int = 100) -> float:
    """Jensen-Shannon divergence of two density histograms (each over its own
    range, as the reference does); histograms are aggregated on Spark, the
    ``bins`` numbers are combined on the driver."""
    return _js(*_hist(a, col, bins), *_hist(b, col, bins))


def _js(ca: np.ndarray, wa: float, na: float, cb: np.ndarray, wb: float, nb: float) -> float:
    pa, pb = ca / (na * wa), cb / (nb * wb)
    m = 0.5 * (pa + pb)

    def kl(p, q):
        p, q = p / p.sum(), q / q.sum()
        mask = p > 0
        return float((p[mask] * np.log(p[mask] / q[mask])).sum())

    return 0.5 * (kl(pa, m) + kl(pb, m))


def find_elbow(curve: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Point of a curve farthest from the chord between its first and last
    point, after min-max normalisation of both axes.  One aggregate for the
    extremes and end points, one ``max_by``; returns the elbow's ``x``."""
    st = curve.agg(F.min(x).alias("x0n"), F.max(x).alias("x1n"), F.min(y).alias("y0n"), F.max(y).alias("y1n"),
                   F.min_by(y, x).alias("yf"), F.max_by(y, x).alias("yl")).first()
    dx = (st["x1n"] - st["x0n"]) or 1.0
    dy = (st["y1n"] - st["y0n"]) or 1.0
    xn = (F.col(x) - F.lit(st["x0n"])) / F.lit(float(dx))
    yn = (F.col(y) - F.lit(st["y0n"])) / F.lit(float(dy))
    xf, xl = 0.0, 1.0
    yf = (st["yf"] - st["y0n"]) / dy
    yl = (st["yl"] - st["y0n"]) / dy
    den = math.sqrt((yl - yf) ** 2 + (xl - xf) ** 2) or 1.0
    dist = F.abs(F.lit(yl - yf) * xn - F.lit(xl - xf) * yn + F.lit(xl * yf - yl * xf)) / F.lit(den)
    return curve.agg(F.max_by(F.col(x), F.struct(dist, -F.col(x))).alias("elbow_x"))


def representative_sample_size(df: DataFrame, col: str, id_col: str = "id", reps: int = 5,
                               n_sizes: int = 25, seed: int = 0, distance: str = "ks", bins: int = 100) -> DataFrame:
    """Sample sizes log-spaced from 10 to N; for each, ``reps`` seeded samples
    (smallest hash ranks); mean distance of sample and full distribution
    (``ks``: Kolmogorov-Smirnov, ``js``: Jensen-Shannon of histograms); the
    elbow of that curve is the representative size.

    The samples of a repetition are nested, so one ranking by hash and one
    aggregate over the values give the distances of all its sizes."""
    if distance not in ("ks", "js"):
        raise ValueError(f"distance must be ks or js, not {distance!r}")
    ensure_checkpoint_dir(df.sparkSession)
    base = df.select(F.col(col).cast("double").alias("v"), F.col(id_col).alias("id")) \
        .filter(F.col("v").isNotNull()).checkpoint()
    N = base.count()
    sizes = sorted(set(int(s) for s in np.logspace(1, math.log10(max(N, 10)), n_sizes)))
    results = []
    for r in range(reps):
        key = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"rs{seed}-{r}"), F.col("id").cast("string"))), 1, 13),
                     16, 10).cast("double")
        ranked = group_row_index(base.select("v", "id", key.alias("h")), None, ["h", "id"], "r")
        # the first size whose sample has the row
        first = F.size(F.filter(F.array(*[F.lit(s) for s in sizes]), lambda s: s <= F.col("r")))
        per = ranked.select("v", first.alias("j")).groupBy("v", "j").agg(F.count(F.lit(1)).alias("c"))
        dist = _nested_ks(per, sizes, N) if distance == "ks" else _nested_js(per, sizes, bins)
        results += [(n, r, float(d)) for n, d in zip(sizes, dist)]
    spark = df.sparkSession
    curve = spark.createDataFrame(results, "x long, rep int, d double").groupBy("x").agg(F.avg("d").alias("y"))
    return find_elbow(curve).select(F.col("elbow_x").alias("sample_size"))


def _nested_ks(per: DataFrame, sizes: list[int], n: int) -> list[float]:
    """KS distances of nested samples, from counts c of a value v in sample j
    but in no smaller one (j = number of sizes: in none)."""
    names = [f"s{j}" for j in range(len(sizes))]
    values = per.groupBy("v").agg(F.sum("c").cast("double").alias("all"), *[
        F.sum(F.when(F.col("j") <= j, F.col("c")).otherwise(0)).cast("double").alias(x) for j, x in enumerate(names)])
    cum = running_sums(values, ["v"], ["all", *names])
    row = cum.agg(*[F.max(F.abs(F.col(f"cum_{x}") / F.lit(float(min(s, n))) - F.col("cum_all") / F.lit(float(n))))
                    for x, s in zip(names, sizes)]).first()
    return [round(d, 6) for d in row]


def _nested_js(per: DataFrame, sizes: list[int], bins: int) -> list[float]:
    """The same for the Jensen-Shannon divergence of histograms, each over the
    range of its own sample."""
    k = len(sizes)
    spread = per.select("v", "c", F.explode(F.sequence(F.col("j"), F.lit(k))).alias("j"))  # k: all rows
    lim = {r["j"]: (r["lo"], r["hi"], r["n"]) for r in per.select("v", "c", F.explode(F.sequence(F.col("j"), F.lit(k))).alias("j"))
           .groupBy("j").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("c").alias("n")).collect()}
    width = {j: (hi - lo) / bins if hi > lo else 1.0 for j, (lo, hi, _) in lim.items()}
    low = F.array(*[F.lit(float(lim[j][0]) if j in lim else 0.0) for j in range(k + 1)])
    step = F.array(*[F.lit(float(width.get(j, 1.0))) for j in range(k + 1)])
    at = F.least(F.floor((F.col("v") - F.element_at(low, F.col("j") + 1)) / F.element_at(step, F.col("j") + 1)), F.lit(bins - 1))
    hist = {j: np.zeros(bins) for j in lim}
    for r in spread.groupBy("j", at.cast("int").alias("b")).agg(F.sum("c").alias("c")).collect():
        hist[r["j"]][r["b"]] = r["c"]
    return [_js(hist[j], width[j], float(lim[j][2]), hist[k], width[k], float(lim[k][2])) for j in range(k)]


# --- elbow split ---------------------------------------------------------------------
POLY_DEGREE = 7


def fit_curve(ranked: DataFrame, n: int, degree: int = POLY_DEGREE) -> np.ndarray:
    """Least-squares polynomial of the curve (r, y), r = 0..n-1, in
    z = 2 r / (n - 1) - 1, lowest power first.  One aggregate sums the powers
    over all rows; the normal equations have ``degree + 1`` unknowns."""
    z = F.col("r") * F.lit(2.0 / (n - 1)) - 1.0
    powers = [F.sum(F.pow(z, F.lit(float(k)))) for k in range(2 * degree + 1)]
    moments = [F.sum(F.col("y") * F.pow(z, F.lit(float(k)))) for k in range(degree + 1)]
    row = ranked.agg(*powers, *moments).first()
    gram = np.array([[row[i + j] for j in range(degree + 1)] for i in range(degree + 1)])
    return np.linalg.lstsq(gram, np.array(row[2 * degree + 1:]), rcond=None)[0]


def knee_rank(coef: np.ndarray, n: int) -> int | None:
    """Kneedle's knee of the convex decreasing polynomial curve over the ranks
    0..n-1 (sensitivity 1), found from its critical points alone: the
    normalised difference curve is monotone between them, so the rule (the
    last local maximum whose threshold is crossed before the next one) needs
    its values only there."""
    poly = np.polynomial.Polynomial(coef)

    def at(rank):
        return float(poly(2.0 * rank / (n - 1) - 1.0))

    def ranks_of(p):
        z = [r.real for r in p.roots() if abs(r.imag) < 1e-9 and -1 < r.real < 1]
        return [(x + 1) / 2 * (n - 1) for x in z]

    def nearby(values):
        return {min(max(int(round(v)) + d, 0), n - 1) for v in values for d in (-1, 0, 1)}

    slope = poly.deriv()
    ends = nearby(ranks_of(slope)) | {0, n - 1}
    low, high = min(map(at, ends)), max(map(at, ends))
    span = (high - low) or 1.0

    def diff(rank):
        return 1.0 - (at(rank) - low) / span - rank / (n - 1)

    if high == low:
        def diff(rank):  # noqa: F811  a flat curve: the flipped curve is flat at 0
            return -rank / (n - 1)
    turning = sorted({max(nearby([r]), key=diff) if curve < 0 else min(nearby([r]), key=diff)
                      for r in ranks_of(slope + span / 2)
                      for curve in [-float(slope.deriv()(2 * r / (n - 1) - 1))]} | {0, n - 1})
    kinds = {}
    for i, r in enumerate(turning):
        before, after = diff(turning[i - 1]) if i else None, diff(turning[i + 1]) if i + 1 < len(turning) else None
        here = diff(r)
        if (before is None or here >= before) and (after is None or here >= after):
            kinds[r] = "max"
        elif (before is None or here <= before) and (after is None or here <= after):
            kinds[r] = "min"
    turning = [r for r in turning if r in kinds]
    start = next((i for i, r in enumerate(turning) if kinds[r] == "max"), None)
    if start is None:
        return None
    threshold, knee = 0.0, turning[start]
    for i in range(start, len(turning)):
        r, end = turning[i], turning[i + 1] if i + 1 < len(turning) else n - 1
        if kinds[r] == "max":
            threshold, knee = diff(r) - 1.0 / (n - 1), r
        else:
            threshold = 0.0
        if r < end and min(diff(r + 1), diff(end)) < threshold:
            return knee
    return None


def elbow_high_flag(df: DataFrame, metric: str, id_col: str = "id", flag: str = "__high") -> DataFrame:
    """Sort descending, partition_1 = the first ``knee`` rows (the HIGH values),
    partition_2 = the rest; ``flag`` marks partition_2, so quality=True on a
    higher-is-better metric keeps the LOW tail.  The flag is NULL on all rows
    when there is no knee, False for rows without a metric, and True on all
    rows when fewer than three have one.

    The curve over all rows is ranked by a distributed sort of (metric, id) and
    fitted by one aggregate; the split is exact at the knee's row."""
    keys = df.select((-F.col(metric).cast("double")).alias("nm"), F.col(id_col).alias("id")).filter("nm IS NOT NULL")
    ranked = group_row_index(keys, None, ["nm", "id"], "r")
    n = ranked.count()
    known = F.col(metric).isNotNull()
    if n < 3:
        return df.withColumn(flag, known)
    knee = knee_rank(fit_curve(ranked.select("r", (-F.col("nm")).alias("y")), n), n)
    if knee is None:
        return df.withColumn(flag, F.when(~known, F.lit(False)))
    row = ranked.filter(F.col("r") == knee).first()
    nm = -F.col(metric).cast("double")
    in_top = (nm < F.lit(row["nm"])) | ((nm == F.lit(row["nm"])) & (F.col(id_col) < F.lit(row["id"])))
    return df.withColumn(flag, F.coalesce(~in_top, F.lit(False)))
