"""The pipeline: each stage against plain code on its own input, odd rows, and without the subpackage."""

import os
import shutil
import subprocess
import sys

import corpus_pipeline
from test_llm_decontaminate import _words
from test_llm_simhash import _plain as near_groups

from corpusaudit.llm import decontaminate, language, mixing, quality

_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _ids(df):
    return sorted((r["doc_id"] for r in df.select("doc_id").collect()), key=str)


def test_stages_against_plain_code(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("labels", "benchmark"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, before, sf_dir)
        assert docs.dtypes == before.dtypes
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        kept[name] = (before, docs)
    before, after = kept["quality classifier"]
    model = quality.fit(before, labels)
    rows = before.select("doc_id", "text").collect()
    scores = model.score(quality._matrix(r["text"].encode() for r in rows))
    assert _ids(after) == sorted((r["doc_id"] for r, s in zip(rows, scores) if s >= 0.3), key=str)
    before, after = kept["language ID"]
    coder = language.Coder(language.fit(before))
    assert _ids(after) == sorted((r["doc_id"] for r in before.collect() if coder.identify(r["text"])[2]), key=str)
    before, after = kept["SimHash near-dedup"]
    groups = near_groups([(r["doc_id"], r["text"]) for r in before.collect()])
    assert _ids(after) == sorted({g for _, _, g in groups}, key=str)
    before, after = kept["benchmark decontamination"]
    items = [" ".join(_words(r["text"])) for r in benchmark.collect()]
    held = {r["doc_id"] for r in before.collect() if any(f" {i} " in f" {' '.join(_words(r['text']))} " for i in items)}
    said = {r["doc_id"] for r in decontaminate.contaminated(before, benchmark).collect()}
    assert held <= said and _ids(after) == sorted(set(_ids(before)) - said, key=str)
    before, after = kept["mixing to target weights"]
    assert _ids(after) == _ids(mixing.mix(before).where("kept"))
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(tuple, after.collect()))


def test_odd_rows_and_columns(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = [(None, None, None, None, None), (9_000, "", "en", "src0", 0), (9_001, "x" * 300_000, None, None, 300_000), (9_002, " \n", "de", "s", 2)]
    odd += [tuple(r) for r in docs.limit(30).collect()] * 2
    mixed = docs.unionByName(spark.createDataFrame(odd, _SCHEMA)).selectExpr(
        "*", "1 AS score", "'x' AS probability", "2 AS topic", "3 AS tokens", "4 AS print", "5 AS said", "6 AS mix_topic", "7 AS chosen", "8 AS fp"
    )
    for df in (mixed, mixed.limit(0)):
        rows = df
        for _, stage in corpus_pipeline.STAGES:
            rows = stage(spark, rows, sf_dir)
            assert rows.columns == df.columns
            rows = spark.createDataFrame(rows.collect(), df.schema)
        assert rows.count() <= df.count()


def test_without_the_subpackage(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    shutil.copytree(f"{root}/corpusaudit", tmp_path / "corpusaudit", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q); print('fine')"
    said = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert said.stdout.strip() == "fine", said.stderr[-800:]
