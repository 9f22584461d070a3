"""Every option of a run configuration is carried out or refused."""

import json

import pytest
from pyspark.sql import functions as F

from corpus_spark.operators import lm
from corpus_spark.plans.sieve import run_config
from corpus_spark.sources import io

ENG = "The river runs past the old windmill and the sleepy town beyond it."
RUS = "Река течёт мимо старой мельницы и сонного города за ней."
SCHEMA = "id long, text string, language string, source string, url string"
ROWS = [(0, ENG, "eng", "wiki", "u0"), (1, ENG + "\n" + RUS, "eng", "mc4", "u1"), (2, RUS, "rus", "wiki", "u2"),
        (3, "Short\n" + RUS + "\nOK", "rus", "mc4", "u3"), (4, ENG, "fra", "wiki", "u4")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def run(docs, cfg, **kw):
    return {r.id: r.text for r in run_config(docs, {"experiment": "t", "languages": ["eng", "rus"], **cfg}, **kw).collect()}


def test_scripts_and_urls_together(docs):
    out = run(docs, {"pre_filter": {"script_regex": True, "urls_to_remove": ["u0"]}})
    assert set(out) == {1, 2, 3} and "Река" not in out[1] and "Short" not in out[3]
    assert set(run(docs, {"pre_filter": {"urls_to_remove": ["u0", "u2"]}})) == {1, 3}


def test_warn_percent(docs, caplog):
    assert set(run(docs, {"pre_filter": {"script_regex": True, "warn_percent": 0.4}})) == {0, 1, 2, 3}
    assert "of 1 documents" in caplog.text  # document 1 lost its Russian half
    caplog.clear()
    run(docs, {"pre_filter": {"script_regex": True, "warn_percent": 0.9}})
    assert "pre_filter removed" not in caplog.text
    with pytest.raises(ValueError):
        run(docs, {"pre_filter": {"script_regex": True, "warn_percent": 2}})


def test_language_id(docs, spark):
    profiles = lm.train_lang_profiles(docs.where("id in (0, 2)"))
    out = run(docs, {"pre_filter": {"lang_id": True}}, lang_profiles=profiles)
    assert out == {0: ENG, 1: ENG, 2: RUS, 3: RUS + "\nOK"}  # OK is too short to tell
    assert set(run(docs, {"pre_filter": {"lang_id": True}})) == {0, 1, 2, 3}  # profiles of the documents themselves
    one = run_config(docs.drop("language"), {"experiment": "t", "languages": ["eng"], "pre_filter": {"lang_id": True}},
                     lang_profiles=profiles)
    assert {r.id: r.text for r in one.collect()} == {0: ENG, 1: ENG, 3: "OK", 4: ENG} and "language" not in one.columns
    with pytest.raises(ValueError, match="lang_profiles"):
        run_config(docs, {"experiment": "t", "languages": ["eng"], "pre_filter": {"lang_id": True}})


def test_sources_and_load_path(docs, spark, tmp_path):
    assert set(run(docs, {"sources": ["wiki"]})) == {0, 2}
    with pytest.raises(ValueError, match="source"):
        run(docs.drop("source"), {"sources": ["wiki"]})
    with pytest.raises(ValueError, match="Unknown source"):
        run(docs, {"sources": ["nowhere"]})
    path = str(tmp_path / "corpus")
    io.save_corpus(docs.drop("url"), path)
    cfg = {"experiment": "t", "languages": ["eng", "rus"], "load_path": path}
    assert {r.id for r in run_config(None, cfg, spark=spark).collect()} == {0, 1, 2, 3}
    with pytest.raises(ValueError):
        run_config(docs, cfg, spark=spark)
    with pytest.raises(ValueError, match="Nothing to load"):
        run_config(None, {"experiment": "t", "languages": ["eng"]})
    raw = {"wiki": docs.where("language = 'eng'").select(F.lit("1").alias("id"), "url", F.lit("x").alias("title"), "text")}
    got = run_config(None, {"experiment": "t", "languages": ["eng"], "sources": ["wiki"]}, tables=raw)
    assert got.count() == 2 and {r.source for r in got.collect()} == {"wiki"}
    with pytest.raises(ValueError, match="No table"):
        run_config(None, {"experiment": "t", "languages": ["eng"], "sources": ["mc4"]}, tables=raw)


def test_tokenizers(docs):
    spaces = {"spaces": lambda c: F.split(c, " ")}
    cfg = {"threshold": {"thresholds": {"length_words": 13}, "tokenizer": "spaces"}}
    assert set(run(docs, cfg, tokenizers=spaces)) == {r[0] for r in ROWS[:4] if len(r[1].split(" ")) >= 13} != set()
    with pytest.raises(ValueError, match="Unknown tokenizer"):
        run(docs, cfg)
    # with one token per document, equal up to the tokenizer
    first = {"deduplicate": {"exact_match": True, "tokenizer": "first"}}
    assert set(run(docs, first, tokenizers={"first": lambda c: F.array(F.substring(c, 1, 1))})) == {0, 2, 3}
    both = {**first, "threshold": {"thresholds": {"length_words": 2}}}
    assert set(run(docs, both, tokenizers={"first": lambda c: F.array(F.substring(c, 1, 1))})) == {0, 2, 3}


def test_models_and_perplexity(docs):
    cfg = {"partition": {"metrics": "perplexity", "split_method": "balanced_docs", "model": "m"}}
    assert len(run(docs, cfg, models={"m": docs})) == 2
    with pytest.raises(ValueError, match="Unknown model"):
        run(docs, cfg)
    with pytest.raises(ValueError, match="model"):
        run(docs, {"threshold": {"thresholds": {"length_words": 1}, "model": "m"}}, models={"m": docs})


def test_merge_test(docs):
    with_split = docs.withColumn("split", F.when(F.col("id") == 1, "test").otherwise("train"))
    out = run_config(with_split, {"experiment": "t", "languages": ["eng", "rus"],
                                  "threshold": {"thresholds": {"length_chars": 1}, "merge_test": True}})
    assert {r.split for r in out.collect()} == {"train"} and out.count() == 4
    with pytest.raises(ValueError, match="splits"):
        run(docs, {"threshold": {"thresholds": {"length_chars": 1}, "merge_test": True}})


def test_weight_file(docs, tmp_path):
    path = tmp_path / "weights.json"
    path.write_text(json.dumps({"eng": 1.0, "rus": 1.0}))
    out = run(docs, {"language_sampling": {"sampling_strategy": "uniform", "raw_weights": str(path)}})
    assert set(out) == {0, 1, 2, 3}
    path.write_text(json.dumps({"eng": 1.0}))
    with pytest.raises(ValueError, match="weights"):
        run(docs, {"language_sampling": {"sampling_strategy": "uniform", "raw_weights": str(path)}})


def test_whole_chain_reads_text_once_more(docs):
    out = run_config(docs, {"experiment": "t", "languages": ["eng", "rus"], "deduplicate": {"exact_match": True, "min_hash": True},
                            "threshold": {"thresholds": {"length_words": 3}},
                            "partition": {"metrics": ["length_chars", "length_words"], "split_method": "balanced_chars",
                                          "join_partitions_by": "union"}})
    plan = out._jdf.queryExecution().toString()
    assert "InMemory" not in plan and out.columns == docs.columns


@pytest.mark.parametrize("bad", [
    {"pre_filter": {}}, {"pre_filter": {"script_regex": True, "unknown": 1}}, {"deduplicate": {"exact_match": False}},
    {"partition": {"metrics": "length_chars", "split_method": "balanced_chars", "join_partitions_by": "scores"}},
    {"threshold": {"thresholds": {"nope": 1}}}, {"load_path": "x", "sources": ["wiki"]}, {"streaming": True},
    {"language_sampling": {"sampling_strategy": "uniform", "interleaving_strategy": "x"}}])
def test_refused(docs, bad):
    with pytest.raises(ValueError):
        run(docs, bad)
