import re
from collections import Counter, defaultdict

from corpus_spark.llm.line_quality import op2_line_quality, quality_rules, remove_lines

from .conftest import HARD_TEXTS

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often, hit = Counter(grams), set()
    for i, g in enumerate(grams):
        if often[g] > 1:
            hit |= {i, i + 1, i + 2}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit))


def brute(rows, max_docs, least_left):
    """rows: (doc_id, text, host)"""
    def lines(t):
        out = Counter()
        for line in (t or "").split("\n"):
            w = WORD.findall(line)
            if w:
                out[" ".join(w).translate({c: c + 32 for c in range(65, 91)})] += len(w)
        return out
    holds = defaultdict(list)
    for d, t, h in rows:
        for x in lines(t):
            holds[h, x].append(d)
    out = []
    for d, t, h in rows:
        b = base(t)
        gone = 0
        for x, n in lines(t).items():
            docs = holds[h, x]
            if len(docs) > max_docs and min(docs) != d:
                gone += n
        failed = b[0] < 50 or 100 * b[4] > 50 * b[0]
        out.append((d, *b, failed, not failed and b[0] - gone >= least_left * b[0], gone))
    return sorted(out)


def test_hard_texts_and_limits(spark):
    rows = [(i, t, "h") for i, t in enumerate(HARD_TEXTS)]
    words = [f"w{i}" for i in range(300)]
    for i in range(40):
        own = " ".join(words[(i * 7 + j * (i + 3)) % 300] for j in range(60))
        rows.append((100 + i, f"Common  Line here\n{own}\nsecond shared line " + "x " * (i % 3), "a" if i % 4 else "b"))
    rows += [(200 + i, "common line HERE\n" + "\n".join(f"shared {j} " + " ".join(words[j * 30:j * 30 + 9]) for j in range(9)) + f"\nend {i}", "a")
             for i in range(12)]
    rows.append((300, "Common line here\nonly", None))
    df = spark.createDataFrame([(d, t, h, 0, 1.5) for d, t, h in rows],
                               "doc_id long, text string, source string, kept int, content double")
    got = quality_rules(df, max_docs=5).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")
    want = brute(rows, 5, 0.5)
    assert sorted(map(tuple, got.collect())) == want
    assert any(not w[7] and not w[6] for w in want) and any(w[8] and w[7] for w in want)
    verdicts = quality_rules(df, max_docs=5)
    left = {r.doc_id: r for r in remove_lines(df, verdicts).collect()}
    assert set(left) == {w[0] for w in want if w[7]}
    for w in want:
        if w[7]:
            assert base(left[w[0]].text)[0] == w[1] - w[8] and left[w[0]].kept == 0


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string, n_chars long")
    v = quality_rules(df)
    assert v.count() == 0 and remove_lines(df, v).count() == 0


def test_query(spark):
    d = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "source").collect()]
    got = op2_line_quality(spark, d).drop("removed_lines")
    assert sorted(map(tuple, got.collect())) == brute(rows, 20, 0.5)


def test_null_and_repeated_ids(spark):
    words = " ".join(f"w{i}" for i in range(70))
    rows = [(None, words + f"\nline {i}\ncommon line", "h") for i in range(4)] + [(None, words, None), (7, words, "h"), (7, words, "h"), (7, None, "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    v = quality_rules(df, max_docs=2)
    got = v.collect()
    assert len(got) == len(rows) and sum(r.kept for r in got) + sum(r.base_failed for r in got) <= len(rows)
    assert [r.n_words for r in got if r.doc_id == 7].count(70) == 2
    left = remove_lines(df, v)
    assert left.count() == sum(r.kept for r in got) and left.columns == df.columns


def test_oracle_sql_equals_the_query(spark):
    import duckdb

    from corpus_spark.llm.line_quality import OP2_SQL
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{d}/documents.parquet'")
    want = con.sql(OP2_SQL)
    got = op2_line_quality(spark, d).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_limit_does_not_follow_the_host(spark):
    """The same boilerplate has the same verdict in a small host and in one of twenty times as many documents; copies count."""
    def rows(n, host):
        out = []
        for i in range(n):
            own = "\n".join(" ".join(f"{host}{i}x{j * 9 + k}" for k in range(9)) for j in range(8))
            out.append((len(host) * 100_000 + i, own + ("\nall rights reserved by nobody" if i < 30 else "\nseen in few" if i < 45 else ""), host))
        return out
    copies = [(900_000 + i, "one text that is copied " + " ".join(f"c{j}" for j in range(60)), "copies") for i in range(25)]
    df = spark.createDataFrame(rows(100, "h") + rows(2000, "hh") + copies, "doc_id long, text string, source string")
    got = quality_rules(df).where("removed_words > 0").select("doc_id", "removed_words", "kept").collect()
    assert sorted((r.doc_id, r.removed_words) for r in got if r.doc_id < 900_000) == sorted(
        (len(h) * 100_000 + i, 5) for h in ("h", "hh") for i in range(1, 30))
    assert sorted(r.doc_id for r in got if r.doc_id >= 900_000) == [900_000 + i for i in range(1, 25)]
    assert not any(r.kept for r in got if r.doc_id >= 900_000)


def test_clashing_columns(spark):
    words = " ".join(f"w{i}" for i in range(70))
    names = ["_id", "_host", "_content", "_h", "_c", "_removed", "_text", "_spans", "_n", "_salt", "h"]
    df = spark.createDataFrame([(i, f"{words} {i}\ncommon line", "s", *range(len(names))) for i in range(30)],
                               "doc_id long, text string, source string, " + ", ".join(f"{n} long" for n in names))
    left = remove_lines(df, quality_rules(df))
    assert left.columns == df.columns and left.count() == 30
    assert all(tuple(r)[3:] == tuple(range(len(names))) for r in left.collect())
    from corpus_spark.llm import near_dup, secret_scan
    kept = near_dup.drop_near_duplicates(df, near_dup.near_duplicates(df, content=True)).collect()
    assert [tuple(r)[3:] for r in kept] == [tuple(range(len(names)))] and kept[0].doc_id == 0
    model = secret_scan.train(secret_scan.labelled_samples(df))
    out = secret_scan.redact(df, secret_scan.find_secrets(df, model))
    assert out.columns == df.columns and sorted(map(tuple, out.collect())) == sorted(map(tuple, df.collect()))
