"""Text folders: files made and read by the tasks, rows as Spark's own writer and reader give them."""
import gzip

import pytest
from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameWriter

from corpuslens.sources import files as IO


def spark_reader(spark, path):
    return spark.read.text(path, wholetext=True).select(
        F.regexp_extract("_metadata.file_path", r"([^/]+)$", 1).alias("name"), F.regexp_replace("value", r"\n$", "").alias("text"))


def test_tasks_make_and_read_the_files(spark, tmp_path, monkeypatch):
    def refuse(*args, **kwargs):
        raise AssertionError("a process is started for each file")
    monkeypatch.setattr(DataFrameWriter, "text", refuse)
    path = str(tmp_path / "t")
    rows = [(1, "one"), (2, "zwei\nZeilen"), (2, "again"), (-3, "é\x00 "), (None, "no id"), (None, None), (5, None), (6, ""), (7, "ends\n")]
    IO.write_text_dir(spark.createDataFrame(rows[:1] * 3, "doc_id long, text string"), path)
    IO.write_text_dir(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), path)   # overwrites
    back = IO.read_text_dir(spark, path)
    assert "FileScan text" not in back._jdf.queryExecution().toString()
    got = {r.doc_id: r.text for r in back.collect()}
    assert got.pop(2) in ("zwei\nZeilen\nagain", "again\nzwei\nZeilen") and got.pop(None) in ("no id", "\nno id")
    assert got == {1: "one", -3: "é\x00 ", 5: "", 6: "", 7: "ends"}
    assert not [f for f in (tmp_path / "t").rglob(".*")] and (tmp_path / "t" / "_SUCCESS").exists()


FLAT = ["12.txt", "a/34.txt", "a/b/9.txt", "with space%.txt", "_hidden", ".hidden/5.txt", "empty.txt", "é [1].txt", "7.txt._COPYING_"]
DEALT = ["doc_id=4/1.txt", "doc_id=4/2 é%#.txt", "doc_id=-5/sub/x.txt", "_hidden/doc_id=6/1.txt", "doc_id=7/empty.txt"]


@pytest.mark.parametrize("names, rows", [(FLAT, 3), (DEALT, 3)])
@pytest.mark.parametrize("compressed", [False, True])
def test_any_folder_reads_as_with_sparks_reader(spark, tmp_path, names, rows, compressed):
    for i, name in enumerate(names):
        file = tmp_path / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(b"" if "empty" in name else f"text {i}\r\nmore\n".encode() + b"\xff")
    if compressed:
        (tmp_path / names[0]).with_name("8.txt.gz").write_bytes(gzip.compress(b"packed\n"))
    got = sorted(tuple(r) for r in IO.read_text_dir(spark, str(tmp_path)).select("name", F.encode("text", "UTF-8")).collect())
    assert got == sorted(tuple(r) for r in spark_reader(spark, str(tmp_path)).select("name", F.encode("text", "UTF-8")).collect())
    assert len(got) == rows + compressed


def test_folders_are_shared(spark, tmp_path, monkeypatch):
    """Not a folder for each document, whose block would outweigh its text."""
    monkeypatch.setattr(IO, "FOLDER_FILES", 30)
    IO.write_text_dir(spark.createDataFrame([(i, f"text {i}") for i in range(200)], "doc_id long, text string"), str(tmp_path / "t"))
    folders = [f for f in (tmp_path / "t").iterdir() if f.is_dir()]
    assert len(list((tmp_path / "t").rglob("*.txt"))) == 200 and len(folders) < 20
    assert max(len(list(f.iterdir())) for f in folders) <= 30
    back = spark_reader(spark, str(tmp_path / "t"))
    want = sorted((f"doc_id={i}.txt", f"text {i}") for i in range(200))
    assert sorted((r.name.split("-", 2)[2], r.text) for r in back.collect()) == want
    assert sorted(tuple(r) for r in IO.read_text_dir(spark, str(tmp_path / "t")).select("doc_id", "text").collect()) == [(i, f"text {i}") for i in range(200)]


def test_ids_that_are_no_numbers_and_missing_folders(spark, tmp_path):
    IO.write_text_dir(spark.createDataFrame([("4", "four"), ("x/y", "other")], "doc_id string, text string"), str(tmp_path / "t"))
    assert sorted((r.doc_id or 0, r.text) for r in IO.read_text_dir(spark, str(tmp_path / "t")).collect()) == [(0, "other"), (4, "four")]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        IO.read_text_dir(spark, str(tmp_path / "none")).collect()
