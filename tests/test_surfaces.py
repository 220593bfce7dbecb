"""Streams, SQL functions, file operations, stored models, pipelines and the driver's contract."""

import random
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from brindle.functions import sql
from brindle.operators.pipeline import image_pipeline
from brindle.sources import files
from brindle.streaming import counts


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.nt").write_text("<http://s> <http://p> <http://o> .\n# no\n<http://s> <http://p> \"x\" .\n")
    q = counts.write_counts(counts.stream_distribution(counts.stream_triples(spark, str(tmp_path / "in"))), "seen", str(tmp_path / "c"))
    q.awaitTermination(60)
    assert [tuple(r) for r in spark.table("seen").collect()] == [("http://s", 2)]


def test_windows(spark, tmp_path):
    spark.range(4).select((F.timestamp_seconds(F.col("id") * 1800)).alias("ts"), F.lit("k").alias("key")).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("ts timestamp, key string").parquet(str(tmp_path / "e"))
    q = counts.write_counts(counts.windowed_distribution(stream, "ts", "key"), "windows", str(tmp_path / "c"))
    q.awaitTermination(60)
    assert sorted(r.cnt for r in spark.table("windows").collect()) == [2, 2]


def test_sql_functions(spark):
    sql.register(spark)
    r = spark.sql("SELECT uri_similarity('spider', 'spider') AS a, uri_similarity('', '') AS b, tokenize_literal('The e-mail') AS c, parse_ntriple('<s> <p> <o> .') AS d").first()
    assert r.a == 0.5 and r.b is None and r.c == ["the", "email"] and tuple(r.d) == ("s", "p", "o")


def test_files(spark, tmp_path):
    (tmp_path / "x").write_text("hello")
    assert files.make_folder(spark, str(tmp_path / "d"))
    files.put(spark, str(tmp_path / "x"), str(tmp_path / "d" / "x"))
    assert files.copy(spark, str(tmp_path / "d" / "x"), str(tmp_path / "d" / "y"))
    assert [p.rpartition("/")[2] for p in files.list_files(spark, str(tmp_path / "d"))] == ["x", "y"]
    files.get(spark, str(tmp_path / "d" / "y"), str(tmp_path / "z"))
    assert (tmp_path / "z").read_text() == "hello" and files.remove(spark, str(tmp_path / "d"), True)


def test_models(spark, tmp_path):
    v = spark.createDataFrame([(1, [1.0, 2.0])], "id long, vec array<double>")
    files.save_vectors(v, str(tmp_path / "v"))
    assert files.load_vectors(spark, str(tmp_path / "v")).first().vec == [1.0, 2.0]
    m = files.metrics(spark, "r", "train", "Loss", [2.0, 1.0])
    assert [r.value for r in files.read_scalar(m, "Loss").collect()] == [2.0, 1.0]


def test_pipeline(spark):
    rng = random.Random(1)
    rows = [([rng.random() + (2 if (i % 2) == (j // 72) else 0) for j in range(144)], i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "x array<double>, y int")
    model = image_pipeline("x", "y", 12, 2, epochs=6, rate=0.1, maps=(2, 3), kernel=3, hidden=8).fit(df)
    out = model.transform(df)
    assert model.stages[1].losses[-1] < model.stages[1].losses[0]
    assert out.agg(F.avg((F.col("prediction") == F.col("y")).cast("double"))).first()[0] > 0.8


DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
def test_contract(spark):
    import __spark_entry__ as entry

    names, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(names) and len(names) >= 70
    assert entry.entry(spark).count() > 0


def test_nothing_else_imports_llm():
    root = Path(__file__).resolve().parent.parent
    found = [p for p in (root / "brindle").rglob("*.py") if "llm" not in p.parts and "brindle.llm" in p.read_text()]
    assert not found
    code = "import sys; sys.modules['brindle.llm'] = None; from brindle.plans import registry; print(len(registry.QUERIES))"
    assert int(subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True).stdout.split()[-1]) > 60
