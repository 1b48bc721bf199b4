"""The queries run where the package is not on the workers' path."""

import os
import subprocess
import sys

SCRIPT = """
import importlib.util, sys
spec = importlib.util.spec_from_file_location("driver", sys.argv[1])
driver = importlib.util.module_from_spec(spec)
spec.loader.exec_module(driver)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").config("spark.checkpoint.dir", sys.argv[3]).getOrCreate()
queries = driver.queries()
for name in "op1_quality op2_language op3_simhash op4_exact_top_k op5_warc op7_url_rules op8_token_lengths op9_masked_lm op10_decontaminate".split():
    assert queries[name](spark, sys.argv[2]).count() > 0, name
print("done")
"""


def test_functions_travel_with_the_job(tmp_path, sf_dir):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    (tmp_path / "script.py").write_text(SCRIPT)
    run = subprocess.run(
        [sys.executable, str(tmp_path / "script.py"), f"{root}/__spark_entry__.py", sf_dir, str(tmp_path / "shared")],
        cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True, timeout=600,
    )
    assert run.stdout.strip().endswith("done"), run.stderr[-2000:]
