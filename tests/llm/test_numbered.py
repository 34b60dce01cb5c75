"""Row ids of a Parquet table come without Python workers."""

from innlytics.llm.common import numbered


def test_numbers_of_files_need_no_python_workers(spark, make_docs, tmp_path):
    path = str(tmp_path / "docs.parquet")
    make_docs([f"text {i}" for i in range(20)]).repartition(3).write.parquet(path)
    docs = spark.read.parquet(path)
    rows, rid = numbered(docs)
    plan = rows._jdf.queryExecution().toString()
    assert "ExistingRDD" not in plan and "LogicalRDD" not in plan  # a list of rows is made one by Python workers
    got = rows.collect()
    assert sorted(r.doc_id for r in got) == list(range(20)) and len({r[rid] for r in got}) == 20
    assert {r[rid] for r in got} == {r[rid] for r in numbered(spark.read.parquet(path))[0].collect()}
