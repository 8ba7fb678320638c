"""The driver's contract, with and without the optional subpackage; declared builds; sinks."""

import json
import subprocess
import sys

import pytest

import __spark_entry__
from corpusmill.plans import build
from corpusmill.sources import sinks


def test_contract(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_without_the_optional_subpackage(tmp_path):
    """Without the two folders, with and without the pipeline's module: all other queries are there, and the rest's tests run."""
    copy = f"{tmp_path}/r"
    subprocess.run(["cp", "-r", ".", copy], check=True)
    subprocess.run(["rm", "-rf", f"{copy}/corpusmill/llm", f"{copy}/tests/llm"], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not any(x.startswith('op1') for x in q) and 'pipeline' not in q; e.oracle_sql(); print('fine')"
    for _ in range(2):
        done = subprocess.run([sys.executable, "-B", "-c", code], cwd=copy, capture_output=True, text=True)
        assert "fine" in done.stdout, done.stderr[-2000:]
        subprocess.run(["rm", "-f", f"{copy}/corpus_pipeline.py"], check=True)
    done = subprocess.run([sys.executable, "-B", "-m", "pytest", "-q", "-x", "-p", "no:cacheprovider", "tests/test_functions.py", "tests/test_operators.py"], cwd=copy, capture_output=True, text=True)
    assert done.returncode == 0, done.stdout[-2000:]


def test_build(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_text("one line here\nOne  line here\n\nanother line\nx\n")
    spark.createDataFrame([("e1", "d", json.dumps({"code_content": "x = 1"}))], "entity_id string, description string, properties string").write.parquet(f"{tmp_path}/e")
    spec = build.BuildSpec.parse(json.dumps({"plan_tokens": 100, "val_fraction": 0.5, "domains": [{"name": "math", "path": f"{tmp_path}/t", "kind": "line", "min_chars": 5, "weight": 3}, {"name": "code", "path": f"{tmp_path}/e", "kind": "entity"}]}))
    rows = build.corpus(spark, spec)
    assert sorted((r.domain, r.text) for r in rows.collect()) == [("code", "x = 1"), ("math", "another line"), ("math", "one line here")]
    assert sum(r.docs for r in build.manifest(rows, spec).collect()) == 3
    assert build.parse_weighted("a=b=0.5") == ("a=b", 0.5)
    with pytest.raises(ValueError):
        build.read_domain(spark, build.Domain("x", f"{tmp_path}/e", "odd"))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "train"), (2, "b", "val")], "doc_id long, text string, split string")
    sinks.write_text(df, f"{tmp_path}/t", gzip=True)
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/t").collect()) == ["a", "b"]
    sinks.write_corpus(df, f"{tmp_path}/c")
    assert spark.read.json(f"{tmp_path}/c/manifest").count() == 2
    sinks.write_splits(df, f"{tmp_path}/s", ["doc_id", "text"])
    assert spark.read.json(f"{tmp_path}/s").where("split = 'val'").count() == 1
    sinks.rewrite(df, f"{tmp_path}/p")
    assert spark.read.parquet(f"{tmp_path}/p").schema == df.schema
    assert sinks.markdown(df.orderBy("doc_id")).splitlines()[2] == "| 1 | a | train |"
    assert sinks.latex_escaped("50% & _x") == r"50\% \& \_x"
