import json

from test_sources import mesh_rows

from lathwork.sources import meshes


def test_files_hold_so_many_faces_whatever_the_batches(spark, tmp_path):
    _, df = mesh_rows(spark, 1000)
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 150)
    try:
        meshes.write_meshes(df.coalesce(1), str(tmp_path / "out"), rows_per_file="200")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    files = meshes.read_meshes(spark, str(tmp_path / "out")).groupBy("model").count().collect()
    assert [r["count"] for r in files] == [200] * 5 and json.loads((tmp_path / "out" / "_SUCCESS").read_text()) == {"faces": 1000}
