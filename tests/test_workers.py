"""Queries with Python tasks run where the package is not on the workers' path."""

import os
import subprocess
import sys

SCRIPT = """
import importlib.util, sys
spec = importlib.util.spec_from_file_location("driver", sys.argv[1])
driver = importlib.util.module_from_spec(spec)
spec.loader.exec_module(driver)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
queries = driver.queries()
for name in "archive_members batch_infer valid_tests similar_ann embed embed_with_fallback".split():
    assert queries[name](spark, sys.argv[2]).count() > 0, name
from corpusaudit.sources import archives, tree
import pathlib, zipfile
root = pathlib.Path(sys.argv[3])
(root / "a").mkdir()
(root / "a" / "x.py").write_text("1")
with zipfile.ZipFile(root / "r.zip", "w") as z:
    z.write(root / "a" / "x.py", "x.py")
assert tree.scan_code_files(spark, {"r": str(root)}).count() == 1
assert archives.read_zip_repos(spark.createDataFrame([(str(root / "r.zip"),)], "archive string")).count() == 1
print("done")
"""


def test_functions_travel_with_the_job(tmp_path, sf_dir):
    entry = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "__spark_entry__.py")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    (tmp_path / "tree").mkdir()
    (tmp_path / "script.py").write_text(SCRIPT)
    run = subprocess.run(
        [sys.executable, str(tmp_path / "script.py"), entry, sf_dir, str(tmp_path / "tree")],
        cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300,
    )
    assert run.stdout.strip().endswith("done"), run.stderr[-2000:]
