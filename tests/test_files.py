"""Scans, sinks and incremental scoring, on small folders."""

import json
import zlib

import pytest

from ratersight.sources import files, sinks
from ratersight.streaming import scoring


def test_predictions(spark, tmp_path):
    bodies = {"p1/s1/x3_output_0.json": '{"rating": 4, "explanation": "e"}', "p1/s1/x3_output_1.json": 'so "rating": 3.7 it is', "p2/s2/x10_output_2.json": "\n", "p2/s2/x11_output_2.json": "", "p2/s2/other.json": "{}", "p2/s2/yx7_output_1.json": '{"rating": 1}', "p2/s2/x1_output_1.txt": "no"}
    for name, body in bodies.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body)
    got = {(r.patient, r.session, r.item, r.run): r.rating for r in files.predictions(spark, str(tmp_path), "x").collect()}
    assert got == {("p1", "s1", 3, 0): 4.0, ("p1", "s1", 3, 1): 3.0, ("p2", "s2", 10, 2): None}
    first = {r.session: r.path.rsplit("/", 1)[1] for r in files.first_texts(spark, str(tmp_path), "*.json").collect()}
    assert first == {"s1": "x3_output_0.json", "s2": "other.json"}
    assert [r.session for r in files.named_texts(spark, str(tmp_path), "x3_output_1.json").collect()] == ["s1"]
    done = files.texts(spark, str(tmp_path), "*.json").filter("session = 's1'").select("path")
    assert {r.session for r in files.unprocessed(spark, str(tmp_path), "*.json", done).collect()} == {"s2"}


def test_lists(spark, tmp_path):
    (tmp_path / "item3.txt").write_text("a/s1/f.txt\n\n  b/s2/g.txt \na/s1/f.txt\nshort\n")
    assert sorted(map(tuple, files.manifest(spark, str(tmp_path / "item3.txt")).collect())) == [(3, "s1"), (3, "s2")]
    assert sorted(r.session for r in files.exclusions(spark, str(tmp_path / "item3.txt")).collect()) == ["f.txt", "g.txt", "short"]
    (tmp_path / "t.csv").write_text("name,n\nx,1\ny,oops\n")
    assert sorted(map(tuple, files.csv_table(spark, str(tmp_path / "t.csv"), "name string, n int").collect())) == [("x", 1), ("y", None)]
    assert sorted(map(tuple, files.csv_texts(spark, str(tmp_path / "t.csv"), "name", "of_").collect())) == [("of_x", "1"), ("of_y", "oops")]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("s2", 1, "one", 0, 0, 2.5), ("s1", 1, "one", 0, 1, None), ("s1", 2, "two", 1, 0, 1.0)], "session string, item int, item_name string, model int, run int, rating double")
    own = sinks.write_predictions(rows, str(tmp_path / "p"))
    assert own.filter("model = 1 and run = 0").count() == 1 and (tmp_path / "p/model=0/run=1").is_dir()
    assert sorted(map(str, sinks.stage(rows, str(tmp_path / "stage")).collect())) == sorted(map(str, rows.collect()))
    sinks.write_sheets(rows, str(tmp_path / "book"))
    assert {p.name for p in (tmp_path / "book").glob("sheet=*")} == {"sheet=01 - one", "sheet=02 - two"}
    assert sinks.latex(rows.filter("item = 2").select("item_name", "rating", "session")) == "two & 1.00 & s1 \\\\\n"
    assert [json.loads(r.j)["item"] for r in rows.filter("item = 2").select(sinks.as_json("item", "rating").alias("j")).collect()] == [2]
    with pytest.warns(UserWarning, match="item 3"):
        back = files.sheets(spark, str(tmp_path / "book"), [1, 2, 3])
    assert sorted((r.item, r.session, r.rating) for r in back.collect()) == [(1, "s1", None), (1, "s2", "2.5"), (2, "s1", "1.0")]
    own = sinks.write_bundle({"rows": rows, "few": rows.limit(1)}, str(tmp_path / "bundle"))
    assert own["rows"].count() == files.bundle(spark, str(tmp_path / "bundle"), ["rows"])["rows"].count() == 3
    blups = spark.createDataFrame([("reason", "item", "7", 0.5, 0.1, 0.9, 1.5)], "stratum string, factor string, level string, dev double, dev_low double, dev_high double, total double")
    sinks.write_table(blups, str(tmp_path / "blups"))
    assert [(r.level, r.dev, r.total) for r in files.blups(spark, str(tmp_path / "blups")).collect()] == [(7, 0.5, 1.5)]
    sinks.write_labelled(spark.createDataFrame([("a", 0, 1, "4", 3)], "key string, model int, run int, body string, label int"), str(tmp_path / "texts"))
    assert next((tmp_path / "texts/model=0/run=1").glob("*.txt")).read_text() == "4\nGround Truth: 3\n"
    report = spark.createDataFrame([("a", "m_1", 0.5, "blue!40"), ("b", "m2", 1.25, "")], "family string, name string, mae double, tint string")
    made = sinks.latex_table(report, ["Model", "MAE"], "All & more", "tab:x", group="family", best={"mae": True}, tints={"mae": "tint"})
    assert "m\\_1 & \\cellcolor{blue!40}\\textbf{0.50} \\\\\nX".rstrip("X") in made and "\\multicolumn{2}{l}{\\textit{b}}" in made and "All \\& more" in made
    csv = sinks.ablation_csv(spark.createDataFrame([("x", 0.5, None)], "config string, i1 double, i2 double"), spark.createDataFrame([("x", 0.25)], "config string, delta double"))
    assert csv == "config,i1,i2\r\nx,0.5000,\r\n\r\nconfig,delta\r\nx,0.2500\r\n"
    effects = spark.createDataFrame([("x", 0.5, 0.1)], "term string, estimate double, se double")
    assert sinks.model_report(effects, {"patients": 3}).split() == ["patients:", "3", "x", "0.500000", "0.100000", "[", "0.304000,", "0.696000]"]
    assert (sinks.mean_and_std(0.125, 0.0), sinks.mean_and_std(None, None)) == ("0.12 ± 0.00", "--")
    with pytest.raises(ValueError):
        sinks.latex(spark.range(sinks.REPORT_ROWS + 1))


def test_scoring(spark, tmp_path):
    schema = "key string, run int, prompt string"
    rows = [(f"k{i}", i % 3, None if i == 7 else f"p{i}") for i in range(200)]
    asked = spark.createDataFrame(rows, schema)
    want = {(k, r): zlib.crc32((p or "").encode(), r) % 7 for k, r, p in rows}
    done = asked.filter("run = 0").select("key", "run")
    got = {(r.key, r.run): json.loads(r.body)["rating"] for r in scoring.score_pending(asked, done).collect()}
    assert got == {k: v for k, v in want.items() if k[1] != 0}
    assert scoring.score(asked.limit(0)).collect() == []
    asked.write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second delivery repeats all requests
        scoring.score_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        asked.write.mode("append").parquet(str(tmp_path / "in"))
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(out) == 200 and {(r.key, r.run): json.loads(r.body)["rating"] for r in out} == want
