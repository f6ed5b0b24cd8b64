import io
import zipfile

import pytest
from conftest import rows
from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from labelmill.functions import templates
from labelmill.sinks import writers
from labelmill.sources import readers, results
from labelmill.streaming import streams


def put(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text, encoding="utf-8")
    return str(p)


def texts(df, kind):
    return [r[0] for r in df.orderBy("row_index").select(readers.resolve_text(df.schema, kind)).collect()]


def test_csv_basic(spark, tmp_path):
    df = readers.load_csv(spark, put(tmp_path, "a.csv", "text,label\none,x\ntwo,y\nthree,z\n"))
    assert sorted(rows(df, "row_index", "text", "label")) == [(0, "one", "x"), (1, "two", "y"), (2, "three", "z")]
    assert texts(df, "csv") == ["one", "two", "three"]


def test_csv_text_column_rules(spark, tmp_path):
    assert texts(readers.load_csv(spark, put(tmp_path, "a.csv", "content,category\nc1,k\n")), "csv") == ["c1"]
    assert texts(readers.load_csv(spark, put(tmp_path, "b.csv", "review,rating\nr1,5\n")), "csv") == ["r1"]
    # Of text and content the later column wins, even when empty; then the first column.
    assert texts(readers.load_csv(spark, put(tmp_path, "c.csv", "id,text,content\n7,t,\n")), "csv") == ["7"]


def test_csv_quoting(spark, tmp_path):
    df = readers.load_csv(spark, put(tmp_path, "a.csv", 'text,n\n"say ""hi"", you",1\n"two\nlines",\n'))
    assert sorted(rows(df, "row_index", "text", "n")) == [(0, 'say "hi", you', "1"), (1, "two\nlines", "")]


def test_csv_bad_rows_keep_their_index(spark, tmp_path):
    df = readers.load_csv(spark, put(tmp_path, "a.csv", "text,label\none,x\ntwo\nthree,z\nfour,a,b\nfive,c\n"))
    assert sorted(rows(df, "row_index", "text")) == [(0, "one"), (2, "three"), (4, "five")]


def test_csv_without_rows(spark, tmp_path):
    with pytest.raises(ValueError, match="at least one valid data row"):
        readers.load_csv(spark, put(tmp_path, "a.csv", "text,label\n"))


def test_json(spark, tmp_path):
    df = readers.load_json(spark, put(tmp_path, "a.json", '[{"text":"a","score":1.5,"n":3,"ok":true,"tags":["x"],"m":{"by":"me"}},{"text":"b"}]'))
    assert dict(df.dtypes)["m"] == "struct<by:string>" and dict(df.dtypes)["n"] == "bigint"
    assert sorted(rows(df, "row_index", "text", "m.by")) == [(0, "a", "me"), (1, "b", None)]
    assert readers.load_json(spark, put(tmp_path, "e.json", "[]")).count() == 0


def test_json_errors(spark, tmp_path):
    with pytest.raises(ValueError, match="array"):
        readers.load_json(spark, put(tmp_path, "o.json", '{"text": "a"}'))
    with pytest.raises((PySparkException, Py4JError)):
        readers.load_json(spark, put(tmp_path, "t.json", '[{"text": "a"}, {"te')).collect()


def test_json_text_rules(spark, tmp_path):
    df = readers.load_json(spark, put(tmp_path, "a.json", '[{"text":"","content":"c","other":"long enough text"},{"content":"c2"},{"other":"long enough text"}]'))
    assert texts(df, "json") == ["", "c2", "long enough text"]


def test_row_index_over_many_files(spark, tmp_path):
    src = spark.range(1000).withColumn("x", F.col("id") * 2)
    for name, n in (("one", 1), ("many", 7)):
        src.repartitionByRange(n, "id").sortWithinPartitions("id").write.parquet(str(tmp_path / name))
        df = readers.load_parquet(spark, str(tmp_path / name))
        assert df.filter("row_index <> id").count() == 0 and df.count() == 1000
    src.repartitionByRange(5, "id").sortWithinPartitions("id").write.option("header", True).csv(str(tmp_path / "c"))
    assert readers.load_csv(spark, str(tmp_path / "c"), multi_line=False).filter("row_index <> id").count() == 0
    assert readers.limit_rows(df, 10).count() == 10


def test_table_dispatch(spark, tmp_path):
    assert readers.load_table(spark, put(tmp_path, "a.CSV", "text\nx\n")).count() == 1
    with pytest.raises(ValueError, match="unsupported file format: .txt"):
        readers.load_table(spark, put(tmp_path, "a.txt", "x"))


def workbook(path, cells):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    body = "".join(
        f'<row r="{i}">' + "".join(f'<c r="{chr(65 + j)}{i}" t="inlineStr"><is><t>{v}</t></is></c>' for j, v in enumerate(r) if v is not None) + "</row>"
        for i, r in enumerate(cells, 1) if r
    )
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")


def test_workbooks(spark, tmp_path):
    workbook(tmp_path / "a.xlsx", [["id", "text", ""], ["1", "one", "lost"], [], ["2"]])
    got = readers.load_table(spark, str(tmp_path / "a.xlsx")).orderBy("row_index").collect()
    assert [(r.row_index, r.cells, r.text) for r in got] == [(0, {"id": "1", "text": "one"}, "one"), (2, {"id": "2"}, "2")]


def test_workbook_shared_strings():
    buf = io.BytesIO()
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>head</t></si><si><r><t>ri</t></r><r><t>ch</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="AA1" t="s"><v>0</v></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="B2"><v>7</v></c></row></sheetData></worksheet>')
    (_, first), (_, second) = readers._sheet_rows(buf.getvalue())
    assert first == [""] * 26 + ["head"] and second == ["rich", "7"]


def test_saved_runs(spark, tmp_path):
    wrapped = put(tmp_path, "w.json", '{"results":[{"index":4,"inference_success":true,"response_time":2500000,"final_answer":"a","extra":"e"}],"summary":{}}')
    bare = put(tmp_path, "b.json", '[{"index":4,"success":true,"response_time":2,"final_answer":"a","extra":"e"}]')
    for path, unit in ((wrapped, "ns"), (bare, "ms")):
        df = results.load_results(spark, path, unit)
        assert rows(df, "row_index", "success", "response_time_ms", "final_answer", "extra") == [(4, True, 2, "a", "e")]


def result_rows(spark):
    return spark.createDataFrame([(0, "u", "a", True, 5, {"k": 1}, "x"), (1, "v", "b", False, 7, {"k": 2}, None)],
                                 "row_index bigint, input_text string, final_answer string, success boolean, response_time_ms bigint, data struct<k:bigint>, note string") \
        .withColumn("raw_response", F.lit(' "r",\n ')).withColumn("ground_truth", F.lit("g")).withColumn("thinking_content", F.lit("t")).withColumn("error", F.lit(""))


def test_sinks(spark, tmp_path):
    df = result_rows(spark)
    out = writers.csv_projection(df, with_truth=True, with_thinking=True)
    assert out.columns == ["data", "note", "raw_response", "thinking_content", "response_time", "inference_success", "final_answer", "ground_truth"]
    assert out.first().data == '{"k":1}'
    writers.write_csv(df, str(tmp_path / "c"))
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "c"))
    assert back.filter("note = 'x'").first().raw_response == ' "r",\n '
    clash = writers.json_projection(df.withColumn("index", F.lit(9)))
    assert clash.first()["orig_index"] == 9 and clash.first()["index"] == 0 and "ground_truth" not in clash.columns
    path = writers.write_results(df, str(tmp_path / "runs"), "json", metric="accuracy", classes=["g"])
    assert spark.read.json(path + "/summary").first().total == 2
    with pytest.raises(ValueError, match="no results"):
        writers.write_parquet_new(df.limit(0), str(tmp_path / "n"))
    with pytest.raises(ValueError, match="unsupported output format"):
        writers.write_results(df, str(tmp_path), "xlsx")


def test_enriched_cuts_and_fills(spark):
    original = spark.range(6).select(F.col("id").alias("row_index"), (F.col("id") * 10).alias("v"))
    df = result_rows(spark).withColumn("row_index", F.col("row_index") * 3)
    cols = ("row_index", "v", "response_time", "inference_success", "final_answer")
    want = [(0, 0, 5, True, "a"), (1, 10, 0, False, None), (2, 20, 0, False, None), (3, 30, 7, False, "b")]
    assert rows(writers.enriched(original, df, cut_unprocessed=True).orderBy("row_index"), *cols) == want
    assert rows(writers.enriched(original, df).orderBy("row_index"), *cols) == want + [(4, 40, 0, False, None), (5, 50, 0, False, None)]


def test_stream_format_is_checked_first(spark):
    with pytest.raises(ValueError, match="unsupported streaming format"):
        streams.stream_results(result_rows(spark), "x", "y", "xlsx")


def test_templates(spark):
    df = spark.createDataFrame([(3, "a {n} $1", 1.5, None, ["x", "y"], {"b": "deep", "c": 2})],
                               "row_index bigint, text string, F double, missing string, tags array<string>, obj struct<b:string,c:bigint>")
    render = lambda t: df.select(templates.render_prompt(df.schema, t)).first()[0]
    assert render("{text}|{f}|{F}|{index}") == "a {n} $1|1.50|1.50|3"
    assert render("{missing}|{tags}|{TAGS}|{nope}") == "|x, y|x, y|{nope}"
    assert render("{obj.b}|{b}|{obj}|{OBJ.B}") == "deep|deep|b: deep, c: 2|deep"
    assert render("no slots") == "no slots" and render("{text}{text}") == "a {n} $1" * 2
    assert templates.field_names(df.schema) == ["F", "missing", "obj", "obj.b", "obj.c", "row_index", "tags", "text"]


def test_csv_files_with_another_column_order_raise(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.csv").write_text("y,x\n3,4\n")
    with pytest.raises(Exception, match="(?i)header"):
        readers.load_csv(spark, str(tmp_path)).collect()
    (tmp_path / "b.csv").write_text("x,y\n3,4\n")
    assert [(r.x, r.y) for r in readers.load_csv(spark, str(tmp_path)).orderBy("row_index").collect()] == [("1", "2"), ("3", "4")]
