"""Exact dedup of a stream into a table, batch by batch."""

from corpus_spark.streaming import stream


def files(spark, folder, parts):
    for i, part in enumerate(parts):
        spark.createDataFrame(part, "id long, text string").coalesce(1).write.mode("append").parquet(f"{folder}/f{i}")


def read(spark, folder):
    return spark.readStream.schema("id long, text string").option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def test_no_duplicate_passes_and_no_state(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    files(spark, src, [[(1, "a b"), (2, "a b"), (3, "c")], [(4, "c"), (5, "d"), (6, None)], [(7, "a b"), (8, ""), (9, "e"), (10, None)]])
    rows = stream.dedup_exact_to_table(read(spark, src), out).collect()
    assert sorted(str(r.text) for r in rows) == ["", "None", "a b", "c", "d", "e"]
    assert len({r.exact_hash for r in rows}) == len(rows) == 6
    assert not (tmp_path / "out-ckpt" / "state").exists()  # nothing in a state store
    # more files: the query goes on; documents of earlier runs are known
    files(spark, f"{src}/more", [[(11, "d"), (12, "f"), (13, None)]])
    again = stream.dedup_exact_to_table(spark.readStream.schema("id long, text string").parquet(f"{src}/*"), out)
    assert len({r.exact_hash for r in again.collect()}) == again.count()


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    import shutil
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    files(spark, src, [[(1, "a"), (2, "b")], [(3, "b"), (4, "c")]])
    first = sorted(r.text for r in stream.dedup_exact_to_table(read(spark, src), out).collect())
    # the last batch was written, but the run ended before it was committed
    commits = sorted((tmp_path / "out-ckpt" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    shutil.move(commits[-1], tmp_path / "gone")
    for crc in (tmp_path / "out-ckpt" / "commits").glob(f".{commits[-1].name}.crc"):
        shutil.move(crc, tmp_path / "gone-crc")
    assert sorted(r.text for r in stream.dedup_exact_to_table(read(spark, src), out).collect()) == first == ["a", "b", "c"]


def test_an_empty_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    files(spark, src, [[]])
    assert stream.dedup_exact_to_table(read(spark, src), str(tmp_path / "out")).count() == 0


def test_tables_of_one_file_and_of_a_folder(spark, tmp_path):
    import glob
    import shutil
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, text string")
    df.write.parquet(str(tmp_path / "many.parquet"))
    df.coalesce(1).write.parquet(str(tmp_path / "x"))
    shutil.copy(glob.glob(str(tmp_path / "x" / "*.parquet"))[0], tmp_path / "one.parquet")
    for name in ("many", "one"):
        s = stream.read_table_stream(spark, str(tmp_path / f"{name}.parquet"), df.schema, 1)
        assert sorted(r.id for r in stream.to_table(s).collect()) == [1, 2]
