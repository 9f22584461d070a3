"""Sources: treebank files, language tables, translation pairs, saved corpora."""

import pytest

from corpus_spark.operators import prep
from corpus_spark.sources import adapters, io, langs

TREE = "# sent_id = s1\n# text = Hi there\n1-2\tHi\t_\t_\t_\t_\t_\t_\t_\t_\n1\tHi\thi\tINTJ\t_\t_\t0\troot\t_\t_\n2\tthere\tthere\tADV\tRB\t_\t1\tadvmod\t_\t_\n\n" \
       "1\tBye\t_\tINTJ\tUH\t_\t0\troot\t_\t_\n1.1\tgone\tgo\tVERB\t_\t_\t_\t_\t1:x\t_\n\n"


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_conllu_values(spark, tmp_path, end):
    folder = tmp_path / "ud_train_set"
    folder.mkdir()
    (folder / "x-test.conllu").write_bytes(TREE.replace("\n", end).encode())
    rows = sorted(io.read_conllu(spark, str(folder)).collect(), key=lambda r: r.idx)
    assert [r.split for r in rows] == ["test", "test"]
    assert [r.idx for r in rows] == ["2", "s1"]
    two, one = rows
    assert one.text == "Hi there" and one.tokens == ["Hi", "Hi", "there"] and one.lemmas == [None, "hi", "there"]
    assert one.head == [None, "0", "1"] and one.xpos == [None, None, "RB"]
    assert two.text == "Bye gone" and two.head == ["0", None] and two.upos_ids[0] == io.UPOS_LABELS.index("INTJ")


def test_split_from_the_folder_of_part_files(spark, tmp_path):
    d = tmp_path / "xx-ud-dev"
    d.mkdir()
    (d / "part-0.txt").write_text(TREE)
    assert {r.split for r in io.read_conllu(spark, str(tmp_path / "*")).collect()} == {"validation"}


def test_only_sentences_without_an_id_are_numbered(spark, tmp_path):
    word = "1\t{}\t_\tX\t_\t_\t0\tdep\t_\t_\n\n"
    with_ids = tmp_path / "a-train.conllu"
    with_ids.write_text("# sent_id = s1\n" + word.format("a") + "# sent_id =\n" + word.format("b"))
    read = io.read_conllu(spark, str(with_ids))
    # nothing is numbered, so no text is shuffled
    assert "Window" not in read._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.idx for r in read.collect()) == ["", "s1"]
    mixed = tmp_path / "b-dev.conllu"
    mixed.write_text(word.format("a") + "# sent_id = s2\n" + word.format("b") + "#\n# text = c d\n" + word.format("c")
                     + "\n\n" + "1\t\u2028# sent_id = x\t_\tX\t_\t_\t0\tdep\t_\t_\n\n")
    rows = io.read_conllu(spark, str(tmp_path / "*")).filter("split = 'validation'").collect()
    assert {r.idx: (r.text, r.tokens, r.upos_ids) for r in rows} == {
        "1": ("a", ["a"], [12]), "s2": ("b", ["b"], [12]), "3": ("c d", ["c"], [12]),
        "4": ("\u2028# sent_id = x", ["\u2028# sent_id = x"], [12])}


def test_translation_pairs_in_all_scripts(spark):
    langs.use_language_table(spark.createDataFrame(
        [("tst", "Test", None, None, ["Latn", "Cyrl"], ["nllb"])],
        "id string, language string, bcp_47 string, wiki_id string, scripts array<string>, sources array<string>"))
    df = spark.createDataFrame([({"tst_Latn": "a", "eng_Latn": "x"},), ({"tst_Cyrl": "б"},), ({"tst_Latn": "c", "tst_Cyrl": "ц"},),
                                ({"eng_Latn": "y"},)], "translation map<string,string>")
    assert sorted(r.text for r in adapters.adapt_translation_pairs(df, "tst").collect()) == ["a", "c", "б", "ц"]
    assert langs.lookup("tst")["sources"] == ["nllb"] and langs.aliases("tst") == ["tst"]
    for table in (langs._BY_ID, langs._BY_ANY):
        table.pop("tst")


def test_subsets_from_a_table(spark):
    df = spark.createDataFrame([("t1", "jpn_Jpan"), ("t2", "eng_Latn"), ("t3", "eng_x")], "text string, subset string")
    assert [r.text for r in adapters.adapt_fineweb(df, "jpn").collect()] == ["t1"]
    sub = spark.createDataFrame([("eng", "eng_Latn"), ("eng", "eng_x")], "language string, subset string")
    assert sorted(r.text for r in adapters.adapt_fineweb(df, "eng", subsets=sub).collect()) == ["t2", "t3"]
    with pytest.raises(ValueError):
        adapters.adapt_fineweb(df, "hau", subsets=sub)


def test_saved_languages_without_a_scan(spark, tmp_path):
    path = str(tmp_path / "c")
    io.save_corpus(spark.createDataFrame([(1, "a", "en"), (2, "b", "fra")], "id long, text string, language string"), path)
    assert io._partition_values(spark, path, "language") == {"en", "fra"}
    assert [r.text for r in io.load_local(spark, path, "eng").collect()] == ["a"]
    with pytest.raises(ValueError):
        io.load_local(spark, path, "deu")


def test_dependency_labels_are_cut_with_the_tokens(spark):
    df = spark.createDataFrame([([-1, 0, 0, 1, 2, -1], [2, 0, 1], [5, 6, 7])],
                               "word_ids array<long>, head array<int>, deprel_ids array<int>")
    r = prep.align_dependency_labels(df, 4).first()
    assert r.labels_head == [-100, 2, -100, 0] and r.labels_rel == [-100, 5, -100, 6]
    assert r.word_starts == [1, 3, -100, -100, -100]
