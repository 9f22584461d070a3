import zlib

import numpy as np
import pyarrow as pa

from corpus_spark.llm.common import text_buffer
from corpus_spark.llm.gam import FEATURES, _grid, _tree, features, fit, keep_good, op5_quality_gam, score_documents, train

from .conftest import HARD_TEXTS


def test_features_are_finite_and_right():
    x = features(*text_buffer(pa.array(HARD_TEXTS, pa.string())))
    assert x.shape == (len(HARD_TEXTS), len(FEATURES)) and np.isfinite(x).all()
    (row,) = features(*text_buffer(pa.array(["AB ab! ab!\n## 12.\n\nab ab! ab!"], pa.string())))
    f = dict(zip(FEATURES, row))
    assert np.isclose(f["log_words"], np.log(9)) and f["distinct_word_share"] == 5 / 8
    assert f["lone_sign_share"] == 1 / 8 and f["words_per_line"] == 8 / 3 and f["closed_line_share"] == 1
    assert np.isclose(f["upper_share"], 2 / 12) and f["bangs_per_word"] == 4 / 8 and f["symbols_per_word"] == 2 / 8


def test_model_learns_additive_and_joint_effects():
    rnd = np.random.default_rng(0)
    x = rnd.normal(size=(6000, 4))
    y = ((np.abs(x[:, 0]) > 1) | ((x[:, 1] > 0) ^ (x[:, 2] > 0)) & (x[:, 0] > -0.5)).astype(float)
    m = fit(x[:4000], y[:4000])
    assert ((m.score(x[4000:]) >= 0.5) == y[4000:]).mean() > 0.93
    assert (1, 2) in {(i, j) for i, j, _ in m.pairs}
    assert (fit(x[:4000], y[:4000]).score(x) == m.score(x)).all()
    assert fit(x[:0], y[:0]).score(x[:2]).tolist() == [0.5, 0.5]
    assert (fit(x[:50], np.ones(50)).score(x) > 0.9).all()


def test_tables_and_hard_texts(spark):
    good = [(i, f"The {i} quiet river runs past old mills and the town sleeps on while bells ring {i * 7}.") for i in range(120)]
    bad = [(1000 + i, f"$$$ ### BUY {i}!!! *** " * 6) for i in range(120)]
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in good + bad + list(enumerate(HARD_TEXTS, 5000)) + [(None, "z")]],
                                 "doc_id long, text string, score string, label int")
    labels = spark.createDataFrame([(d, 1, 0) for d, _ in good] + [(d, 0, 1) for d, _ in bad] + [(7000, 1, 1), (None, 0, 0), (3, None, 0)],
                                   "doc_id long, quality int, toxic int")
    model = train(docs, labels)
    rows = score_documents(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert all(r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    by = {r.doc_id: r.predicted for r in rows}
    assert all(by[d] == 1 for d, _ in good) and all(by[d] == 0 for d, _ in bad)
    kept = keep_good(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if r.predicted}
    empty = train(docs.limit(0), labels.limit(0))
    assert [r.score for r in score_documents(docs.limit(3), empty).collect()] == [0.5] * 3


def test_query_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in op5_quality_gam(spark, d).collect()}
    labels = [r for r in spark.read.parquet(f"{d}/labels.parquet").collect() if rows[r.doc_id].held_out]
    hits = [rows[r.doc_id].predicted == r.quality for r in labels]
    print(len(hits), np.mean(hits), np.mean([r.quality for r in labels]))
    assert np.mean(hits) > 0.95


def loss_of(parts, g, h, ridge):
    """What a tree gains whose leaves are ``parts`` (sets of cells)."""
    return sum(sum(g[c] for c in p) ** 2 / (sum(h[c] for c in p) + ridge) for p in parts if p)


def test_trees_equal_plain_loops():
    rnd = np.random.default_rng(5)
    for _ in range(30):
        n = int(rnd.integers(1, 9))
        g, h = rnd.normal(size=n), rnd.random(n) + 0.1
        # greedy: the best first cut, then the best cut of either half
        leaves = [list(range(n))]
        for _ in range(2):
            best = (1e-9, None)
            for leaf in leaves:
                for k in range(1, len(leaf)):
                    gain = loss_of([leaf[:k], leaf[k:]], g, h, 1.0) - loss_of([leaf], g, h, 1.0)
                    if gain > best[0]:
                        best = (gain, (leaf, k))
            if best[1] is None:
                break
            leaf, k = best[1]
            leaves = [x for x in leaves if x is not leaf] + [leaf[:k], leaf[k:]]
        want = np.zeros(n)
        for leaf in leaves:
            want[leaf] = g[leaf].sum() / (h[leaf].sum() + 1.0)
        assert np.allclose(_tree(g, h, 1.0), want)


def test_grid_equals_plain_loops():
    rnd = np.random.default_rng(6)
    for _ in range(20):
        n = int(rnd.integers(2, 5))
        g, h = rnd.normal(size=(n, n)), rnd.random((n, n)) + 0.1
        cells = [[(i, j) for j in range(n)] for i in range(n)]
        best = 0.0
        for at in range(1, n):
            total = -loss_of([sum(cells, [])], g, h, 1.0)
            for side in (cells[:at], cells[at:]):
                total += max(loss_of([[c for r in side for c in r if c[1] < k], [c for r in side for c in r if c[1] >= k]], g, h, 1.0)
                             for k in range(1, n + 1))
            best = max(best, total)
        # a cut of one side only counts where it gains something, so the two agree up to the penalty of an empty leaf
        assert abs(_grid(g, h, 1.0)[0] - best) < 1e-9


def test_score_equals_plain_loops():
    rnd = np.random.default_rng(7)
    x = rnd.normal(size=(500, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    m = fit(x, y, rounds=20, pair_rounds=10, n_pairs=2)
    for row, got in zip(x[:40], m.score(x[:40])):
        b = [sum(row[j] >= e for e in m.edges[j]) for j in range(3)]
        total = m.intercept + sum(m.tables[j][b[j]] for j in range(3))
        total += sum(t[b[i] // m.coarse][b[j] // m.coarse] for i, j, t in m.pairs)
        assert np.isclose(got, 1 / (1 + np.exp(-total)))
