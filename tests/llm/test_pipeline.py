from __future__ import annotations

import corpus_pipeline
from locusframe.llm.common import stash

DATA = "/root/testdata/sf0.001"


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stash(stage(spark, docs, DATA), "test")
        assert docs.columns == columns
        assert 0 < docs.count() <= n
        n = docs.count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert last.select("doc_id").distinct().count() == n
    assert last.filter("not round_trip").count() == 0


def test_stages_on_awkward_rows(spark, tmp_path):
    prose = [" ".join(f"w{(i * 7 + j * j) % 500}" for j in range(120)) for i in range(40)]
    rows = [(i, t) for i, t in enumerate(prose)] + [(7, prose[7]), (None, prose[8] + " more"), (None, None), (50, None), (51, ""), (52, " \n"), (53, prose[3]), (53, prose[3]), (54, "z" * 5000)]
    docs = spark.createDataFrame([(i, t, 1, 2, "a", "b", "c", 9) for i, t in rows], "doc_id long, text string, _lf_i int, _lf_h int, _lf_gone string, n_lines string, n_removed string, N_CHARS long")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(None, 1, 0), (1, None, 0), (0, 0, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, prose[20][:150]), (None, "x y z"), (2, None), (3, "")], "item_id long, text string")
    for name, table in (("documents", docs), ("labels", labels), ("benchmark", bench)):
        table.write.parquet(str(tmp_path / f"{name}.parquet"))
    at, count = docs, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        at = stash(stage(spark, at, str(tmp_path)), "test")
        if name != "encoding":
            assert at.columns == docs.columns and at.count() <= count
            assert {(r["_lf_i"], r["n_lines"], r["n_removed"]) for r in at.collect()} <= {(1, "b", "c")}
            count = at.count()
        if name == "line_dedup":
            assert {r.doc_id for r in at.filter("doc_id >= 53").collect()} == {54}
        if name == "decontamination":
            left = {r.doc_id for r in at.collect()}
            assert 20 not in left and {1, 5, 50, 51, 52} <= left
    assert at.filter("not round_trip").count() == 0 and at.select("doc_id").distinct().count() == len(left)
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_stages_on_identifiers_that_are_text(spark, tmp_path):
    prose = [" ".join(f"w{(i * 7 + j * j) % 500}" for j in range(120)) for i in range(30)]
    rows = [(f"d{i:02d}", t) for i, t in enumerate(prose)] + [(None, None), ("x", prose[3]), ("y", prose[4] + " more")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    spark.createDataFrame([(f"d{i:02d}", 1, 0) for i in range(30)] + [("none", 0, 0)], "doc_id string, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, prose[20][:150])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    at = docs
    for name, stage in corpus_pipeline.STAGES:
        at = stash(stage(spark, at, str(tmp_path)), "test")
        ids = {r.doc_id for r in at.collect()}
        assert dict(at.dtypes)["doc_id"] == "string"
        if name == "line_dedup":
            assert not ids & {"x"} and {"d03", "d04", None} <= ids
    assert "d20" not in ids and {"d01", "d05", None} <= ids
