"""One Spark session for all tests."""

import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    where = tmp_path_factory.mktemp("spark")
    s = (
        SparkSession.builder.master("local[4]").config("spark.driver.memory", "4g").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.sql.warehouse.dir", f"file://{where}/warehouse").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def one(spark):
    """Evaluates a Column of text functions on given texts: one(lambda t: ..., texts) -> values in order."""
    from pyspark.sql import functions as F

    def run(make, texts, **columns):
        names = list(columns)
        rows = [(i, t, *[columns[n][i] for n in names]) for i, t in enumerate(texts)]
        schema = ", ".join(["i int", "t string", *[f"{n} string" for n in names]])
        df = spark.createDataFrame(rows, schema)
        out = df.select("i", make(F.col("t")).alias("v")).collect()
        return [v for _, v in sorted(((r["i"], r["v"]) for r in out), key=lambda x: x[0])]

    return run
