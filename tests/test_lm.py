import pytest
from pyspark.sql import functions as F

from corpus_spark.operators import lm

ENG = "the cat sat on the mat\n\nthe dog ran\nHi"
DEU = "die Katze saß auf der Matte\nder Hund lief\x85the cat"
ROWS = [(1, ENG, "eng"), (2, DEU, "deu"), (3, "ΣΑΣ İx 😀😀😀\nqqq www", "ell"), (4, None, "eng"), (5, "", "eng"), (6, ENG, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "id long, text string, language string")


def by_join(df, profiles):
    floors = {r["language"]: r["f"] for r in profiles.groupBy("language").agg(F.min("logp").alias("f")).collect()}
    lines = df.select("id", F.posexplode(F.filter(F.transform(lm.splitlines("text"), lambda l: lm.strip(l)),
                                                  lambda l: l != "")).alias("line_no", "line"))
    return lm._predict_by_join(lines, profiles, floors, "id", 3)


def rows(df):
    return sorted(map(tuple, df.select("id", "line_no", "line", "pred").collect()), key=repr)


def test_profiles_counted_in_the_scan(docs):
    """The same log-probabilities as from n-grams that are rows, without one shuffled row an n-gram."""
    got = lm.train_lang_profiles(docs)
    ex = docs.select("language", F.explode(lm.char_ngrams(F.lower("text"), 3)).alias("gram")).filter("language IS NOT NULL")
    n = ex.groupBy("language").agg(F.count("*").alias("t"), F.countDistinct("gram").alias("d"))
    want = ex.groupBy("language", "gram").count().join(n, "language") \
        .select("language", "gram", F.log((F.col("count") + 1) / (F.col("t") + F.col("d") + 1)).alias("logp"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()


def test_lines_scored_in_the_scan(docs, spark):
    """As by the join, and without any shuffle."""
    profiles = lm.train_lang_profiles(docs)
    got = lm.predict_line_languages(docs, profiles)
    assert "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
    assert rows(got) == rows(by_join(docs, profiles))
    assert {r.pred for r in got.collect()} >= {"eng", "deu", "ell", None}


def test_ids_that_repeat_or_lack_and_a_bounded_profile(docs, spark, monkeypatch):
    again = docs.unionByName(spark.createDataFrame(
        [(1, DEU, "deu"), (1, "the", "eng"), (None, ENG, "eng"), (None, DEU, "eng"), (7, "ran zzz\nthe dog", "eng")], docs.schema))
    profiles = lm.train_lang_profiles(docs)
    want = rows(by_join(again, profiles))
    assert rows(lm.predict_line_languages(again, profiles)) == want
    monkeypatch.setattr(lm, "PROFILE_CELLS", 60)
    assert rows(lm.predict_line_languages(again, profiles)) == want
