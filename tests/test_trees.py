"""Trees of files that tasks write, list and read, without sending names to the driver."""

from ratersight.plans import catalog
from ratersight.sources import files, trees

SF = "/root/testdata/sf0.001"


def test_folders_do_not_go_to_the_driver(spark, monkeypatch):
    monkeypatch.setattr(trees, "TASK_FILES", 7)
    from pyspark.sql.readwriter import DataFrameReader, DataFrameWriter

    def refuse(*args, **kwargs):
        raise AssertionError("Spark's driver lists or names these files")

    monkeypatch.setattr(DataFrameReader, "load", refuse)
    monkeypatch.setattr(DataFrameWriter, "text", refuse)
    n = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id").distinct().count()
    texts = catalog.QUERIES["session_texts"](spark, SF)
    assert texts.count() == texts.select("session").distinct().count() == n
    rest = {r.session for r in catalog.QUERIES["unprocessed_texts"](spark, SF).collect()}
    assert rest == {r.session for r in texts.select("session").collect() if int(r.session[8:]) % 3 != 1}


def test_trees(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(trees, "BATCH_BYTES", 1)
    rows = spark.createDataFrame([("1", "a/b:c d", "x\né"), ("1", "e%41", None), (None, "f", "")], "patient string, session string, value string")
    root = f"file://{tmp_path}/in"
    assert trees.write(rows, root, ["patient", "session"], "value") == 3
    assert trees.write(rows, root, ["patient", "session"], "value") == 3  # again, in their place
    got = {(r.patient, r.session): r.text for r in files.texts(spark, root, "*.txt").collect()}
    assert got == {("patient=1", "session=a%2Fb%3Ac d"): "x\né\n", ("patient=1", "session=e%2541"): "\n", ("patient=__HIVE_DEFAULT_PARTITION__", "session=f"): "\n"}
    assert {(r.patient, r.session): r.text for r in spark.read.text(root, wholetext=True).selectExpr("'patient=' || patient as patient", "'session=' || session as session", "value as text").collect()}[("patient=1", "session=a/b:c d")] == "x\né\n"
    assert files.texts(spark, root, "*.json").collect() == []


def test_what_is_listed(spark, tmp_path):
    for name in ("top.txt", "p/s/a.txt", "p/s/b.txt", "p/s/_c.txt", "p/s/.d.txt", "p/_s/a.txt", "p/_s=1/a.txt", "p/s/deep/er/a.txt", "p/s/empty.txt", "p/s/a.json"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"" if "empty" in name else b"\xff!")
    (tmp_path / "p/t").mkdir()
    spark_lists = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(str(tmp_path))
    want = sorted(r.path.removeprefix("file:") for r in spark_lists.select("path").collect())
    assert sorted(r.path for r in files.paths(spark, str(tmp_path), "*.txt").collect()) == want and len(want) == 5
    assert {r.text for r in files.texts(spark, str(tmp_path), "*.txt").collect()} == {"�!"}
    assert {r.path.rsplit("/", 1)[1] for r in files.first_texts(spark, str(tmp_path), "*.txt").filter("session = 's'").collect()} == {"a.txt"}
