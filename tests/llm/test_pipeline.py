import corpus_pipeline
from corpus_spark.llm.gam import features, fit  # noqa: F401
from corpus_spark.llm.common import documents

from . import test_line_quality, test_near_dup, test_packing, test_secret_scan
from .conftest import HARD_TEXTS


def test_stages_equal_brute_force(spark):
    """Every stage on what its predecessor kept, held against plain Python."""
    d = "/root/testdata/sf0.01"
    docs = documents(spark, d)
    rows = {r.doc_id: r for r in docs.collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "quality classifier", "near duplicates", "secret scans", "packing"]
    out = docs
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.materialize(stage(spark, out, d), "t")
        if name != "packing":
            assert out.schema == docs.schema
            now = {r.doc_id: r for r in out.collect()}
            assert out.count() == len(now) and set(now) <= set(rows)
        if name == "quality rules":
            want = test_line_quality.brute([(r.doc_id, r.text, r.source) for r in rows.values()], 20, 0.5)
            assert set(now) == {w[0] for w in want if w[7]}
            for w in want:
                if w[7]:
                    assert test_line_quality.base(now[w[0]].text)[0] == w[1] - w[8]
        elif name == "quality classifier":
            assert 0.6 * len(rows) < len(now) < len(rows)
            assert all(now[k] == rows[k] for k in now)
        elif name == "near duplicates":
            want = test_near_dup.brute([(r.doc_id, r.text) for r in rows.values()], words=5)
            assert set(now) == {w[0] for w in want if w[3]}
        elif name == "secret scans":
            assert set(now) == set(rows)
            for k in now:
                assert not test_secret_scan.base(now[k].text) and now[k].n_chars == len(now[k].text)
                if not test_secret_scan.base(rows[k].text) and "[SECRET]" not in now[k].text:
                    assert now[k].text == rows[k].text
        else:
            assert test_packing.check(out.collect(), [(r.doc_id, r.text) for r in rows.values()]) > 0.95
        rows = now
    packed = corpus_pipeline.run(spark, d)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == set(rows)


def test_hard_tables(spark, tmp_path):
    texts = HARD_TEXTS + ["the quiet river runs past old mills " + " ".join(f"word{i}x{j}" for j in range(80)) for i in range(30)]
    more = ("_id", "_host", "_content", "_text", "_removed", "_spans", "x")
    rows = [(i, t, "en", "s" if i % 2 else None, None if t is None else len(t), *more) for i, t in enumerate(texts)]
    rows += [rows[-1], rows[-1], (None, texts[-2], None, None, None, *more)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _id string, _host string, " \
             "_content string, _text string, _removed string, _spans string, score string"
    for name, part in (("some", rows), ("none", [])):
        d = tmp_path / name
        spark.createDataFrame(part, schema).write.parquet(str(d / "documents.parquet"))
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(d / "labels.parquet"))
        got = corpus_pipeline.run(spark, str(d)).collect()
        assert bool(got) == bool(part)
    assert len(got) == 0
