import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from corpus_spark.session import get_spark
    s = get_spark("local[4]", 4)
    yield s
    s.stop()


# --- small corpora shaped like the reference's fixtures (FIXTURES.md §1-2) ------
# Our own sentences with the same code-point and token counts: 32/7, 33/9,
# 31/8 and 59/12 (the last one five times).
MONO_ROWS = [
    "Seven small cats sat on mats now",
    "Birds sing, dogs bark, cows mooo!",
    "Rain falls on the old red roof.",
] + ["The wide river runs past an old windmill and the townhouse."] * 5


@pytest.fixture(scope="session")
def mono(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(MONO_ROWS)], "id long, text string")


@pytest.fixture(scope="session")
def multi(spark):
    rows = [
        ("First English line, plain and short.", "eng"),
        ("Second English sentence goes right here now.", "eng"),
        ("Third one is English too.", "eng"),
        ("Это предложение написано по-русски для теста.", "rus"),
        ("Αυτή είναι μια ελληνική πρόταση για δοκιμή εδώ τώρα.", "ell"),
        ("这是一个中文句子。", "zho"),
    ]
    return spark.createDataFrame([(i, t, l) for i, (t, l) in enumerate(rows)],
                                 "id long, text string, language string")
