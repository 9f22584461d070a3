"""Knees, sample sizes and estimated thresholds against plain Python."""

import hashlib
import math

import numpy as np
import pytest

from corpus_spark.operators import curves, partition
from corpus_spark.operators.threshold import auto_threshold


def kneedle(y, degree=7):
    """Point by point over the whole descending curve."""
    n = len(y)
    x = np.arange(n)
    z = 2 * x / (n - 1) - 1
    ds = np.polynomial.Polynomial(np.polynomial.polynomial.polyfit(z, y, degree))(z)
    yd = 1 - (ds - ds.min()) / ((ds.max() - ds.min()) or 1.0) - x / (n - 1)
    top = [i for i in range(n) if (i == 0 or yd[i] >= yd[i - 1]) and (i == n - 1 or yd[i] >= yd[i + 1])]
    low = {i for i in range(n) if (i == 0 or yd[i] <= yd[i - 1]) and (i == n - 1 or yd[i] <= yd[i + 1])}
    threshold, knee = 0.0, top[0]
    for i in range(top[0], n - 1):
        if i in top:
            threshold, knee = yd[i] - 1 / (n - 1), i
        if i in low:
            threshold = 0.0
        if yd[i + 1] < threshold:
            return knee
    return None


@pytest.mark.parametrize("seed", range(8))
def test_knee_equals_the_point_by_point_rule(spark, seed):
    rnd = np.random.default_rng(seed)
    n = [12, 60, 300, 2047, 2049, 5000, 900, 40][seed]
    m = [rnd.lognormal(3, 1, n), rnd.exponential(5, n), rnd.normal(50, 9, n), rnd.pareto(3, n)][seed % 4]
    y = np.sort(m)[::-1]
    z = 2 * np.arange(n) / (n - 1) - 1
    coef = np.polynomial.polynomial.polyfit(z, y, 7)
    want = kneedle(y)
    assert curves.knee_rank(coef, n) == want
    if seed in (1, 4):
        df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(m)], "id long, length_chars double")
        out = partition.partition(df, "length_chars", "elbow", keep_columns=True)
        order = sorted(range(n), key=lambda i: (-m[i], i))
        assert {r.id for r in out.collect()} == set(order[want:] if want is not None else order)


def test_rows_without_a_metric_are_in_no_part(spark):
    rows = [(i, float((50 - i) ** 2)) for i in range(50)] + [(100, None)]
    df = spark.createDataFrame(rows, "id long, length_chars double")
    for q in (True, False):
        assert 100 not in {r.id for r in partition.partition(df, "length_chars", "elbow", q, keep_columns=True).collect()}


def ks(sample, full):
    best = 0.0
    for v in set(full):
        best = max(best, abs(sum(x <= v for x in sample) / len(sample) - sum(x <= v for x in full) / len(full)))
    return best


def js(a, b, bins=100):
    def hist(x):
        lo, hi = min(x), max(x)
        w = (hi - lo) / bins if hi > lo else 1.0
        c = np.zeros(bins)
        for v in x:
            c[min(int((v - lo) // w), bins - 1)] += 1
        return c / (len(x) * w)
    pa, pb = hist(a), hist(b)
    m = (pa + pb) / 2
    kl = lambda p, q: sum(x * math.log(x / y) for x, y in zip(p / p.sum(), q / q.sum()) if x > 0)
    return (kl(pa, m) + kl(pb, m)) / 2


@pytest.mark.parametrize("distance", ["ks", "js"])
def test_representative_size(spark, distance):
    rnd = np.random.default_rng(3)
    vals = [float(x) for x in rnd.integers(0, 40, 300)]
    df = spark.createDataFrame(list(enumerate(vals)), "id long, v double")
    sizes = sorted(set(int(s) for s in np.logspace(1, math.log10(300), 6)))
    ys = []
    for n in sizes:
        d = []
        for r in range(2):
            order = sorted(range(300), key=lambda i: (int(hashlib.md5(f"rs0-{r}:{i}".encode()).hexdigest()[:13], 16), i))
            d.append((ks if distance == "ks" else js)([vals[i] for i in order[:n]], vals))
        ys.append(np.mean(d))
    xn = (np.array(sizes) - sizes[0]) / (sizes[-1] - sizes[0])
    yn = (np.array(ys) - min(ys)) / (max(ys) - min(ys))
    dist = np.abs((yn[-1] - yn[0]) * xn - yn + yn[0])
    got = curves.representative_sample_size(df, "v", reps=2, n_sizes=6, distance=distance).first().sample_size
    assert got == sizes[int(dist.argmax())]


def exact_kde(values, grid):
    n, sd = len(values), np.std(values, ddof=1)
    bw = sd * n ** -0.2
    return np.array([np.exp(-0.5 * ((g - values) / bw) ** 2).sum() / (n * bw * math.sqrt(2 * math.pi)) for g in grid])


@pytest.mark.parametrize("n", [400, 3000])
def test_auto_threshold_near_the_exact_densities(spark, n):
    rnd = np.random.default_rng(n)
    vals = np.concatenate([rnd.normal(10, 2, n // 10), rnd.normal(100, 20, n - n // 10)])
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(vals)], "id long, length_chars double")
    k = int(0.05 * n)
    low = np.sort(vals)[:k]
    order = sorted(range(n), key=lambda i: (int(hashlib.md5(f"42:{i}".encode()).hexdigest()[:13], 16), i))
    sample = vals[order[:k]]
    grid = np.linspace(low.min(), sample.max(), 4000)
    want = grid[int(np.argmax(exact_kde(low, grid) - exact_kde(sample, grid)))]
    got = auto_threshold(df, "length_chars")
    assert abs(got - want) < 0.02 * (sample.max() - low.min())
