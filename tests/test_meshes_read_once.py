import contextlib
import io

from lathwork.plans import catalog


def test_binary_meshes_reads_its_files_once(spark, sf_dir):
    said = io.StringIO()
    with contextlib.redirect_stdout(said):
        catalog.QUERIES["binary_meshes"](spark, sf_dir).explain("extended")
    assert said.getvalue().split("== Physical Plan ==")[1].count("BatchScan") == 1
