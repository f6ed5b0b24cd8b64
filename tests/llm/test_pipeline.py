"""The pipeline: stages on small documents, and its result on the smallest tables."""

import pandas as pd

import corpus_pipeline as P

SF = "/root/testdata/sf0.001"


def test_stages_keep_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.toPandas().set_index("doc_id")
    for name, stage in P.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).toPandas(), docs.schema)
        assert docs.columns == P.COLUMNS, name
    out = docs.toPandas().set_index("doc_id")
    assert 0 < len(out) < len(before) and out.index.is_unique and (out.n_chars == out.text.str.len()).all()
    assert out.text.is_unique
    packed = P.run(spark, SF).toPandas()
    assert set(packed.doc_id) == set(out.index) and isinstance(packed, pd.DataFrame)


def test_language_stage_decides_on_evidence(spark):
    de, en = "der die und nicht werden schon über straße müssen haben ", "the and with nothing shall often street through having "
    rows = [(i, (de if i % 2 else en) * 3, "de" if i % 2 else "en") for i in range(40)]
    rows += [(100, "qxz jqk vvw zzx " * 12, None), (101, "Qxj", None), (102, "12 34", None), (103, None, None), (104, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.doc_id for r in P.language_id(spark, docs, SF).collect()} == {*range(40), 101}
    bare = docs.selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert {r.doc_id for r in P.language_id(spark, bare, SF).collect()} == {*range(40), 100, 101}


def test_language_stage_keeps_texts_without_a_learned_language(spark):
    rows = [(None, "some words here", "en"), (3, "12 34", "en"), (4, "some words here", "en"), (1, None, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.doc_id for r in P.language_id(spark, docs, SF).collect()} == {None, 4}


def test_stages_on_nulls(spark):
    rows = [(1, None, "en", "s", 0), (2, "", None, None, None), (None, "some words here", "en", "s", 15), (3, "12 34", "en", "s", 5), (4, "some words here", "en", "s", 15)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == P.COLUMNS
    assert {r.doc_id for r in P.language_id(spark, docs, SF).collect()} == {None, 4}
    # of equal texts the row with an id stays; texts without words are nobody's copies
    assert sorted(r.doc_id for r in P.near_duplicates(spark, docs, SF).collect()) == [1, 2, 3, 4]
