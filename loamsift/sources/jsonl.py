"""JSON Lines and JSON arrays."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import files


def read(spark: SparkSession, path: str, schema: str | StructType | None = None, strict: bool = False) -> DataFrame:
    """One object a line. strict: a bad line fails the read; otherwise bad lines are dropped. Give a schema for large inputs."""
    r = spark.read.option("mode", "FAILFAST" if strict else "DROPMALFORMED")
    return (r.schema(schema) if schema else r).json(path)


def write(df: DataFrame, path: str, append: bool = False, nulls: bool = True) -> None:
    df.write.mode("append" if append else "overwrite").option("ignoreNullFields", str(not nulls).lower()).json(path)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where(F.col("value").rlike(r"(?U)\S"))


def count(spark: SparkSession, path: str) -> int:
    """Lines that aren't blank."""
    return _lines(spark, path).count()


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    return _lines(spark, path).where(F.try_parse_json("value").isNull())


def is_valid(spark: SparkSession, path: str) -> bool:
    return bad_lines(spark, path).isEmpty()


def array_to_lines(spark: SparkSession, source: str, target: str, schema: str | None = None) -> None:
    """A JSON array file to JSON Lines; a file that holds no array is refused."""
    head = spark.read.text(source).where(F.trim("value") != "").select(F.ltrim("value")).first()
    if head is None or not head[0].startswith("["):
        raise ValueError(f"{source} holds no JSON array")
    r = spark.read.option("multiLine", "true")
    write((r.schema(schema) if schema else r).json(source), target)


def lines_to_array(spark: SparkSession, source: str, target: str, schema: str | None = None) -> None:
    """JSON Lines to one indented array file; streams through the driver, one row at a time."""
    import json

    with Path(target).open("w", encoding="utf-8") as f:
        f.write("[")
        for i, row in enumerate(read(spark, source, schema).toJSON().toLocalIterator()):
            f.write(("," if i else "") + "\n  " + json.dumps(json.loads(row), ensure_ascii=False))
        f.write("\n]\n")


def load(spark: SparkSession, folder: str, name: str, schema: str | None = None) -> DataFrame:
    """NAME.jsonl if it exists, else NAME.json."""
    lines_, array = files.below(folder, name + ".jsonl"), files.below(folder, name + ".json")
    if files.exists(spark, lines_):
        return read(spark, lines_, schema)
    if files.exists(spark, array):
        r = spark.read.option("multiLine", "true")
        return (r.schema(schema) if schema else r).json(array)
    raise FileNotFoundError(f"no {name}.jsonl or {name}.json in {folder}")


def merge(spark: SparkSession, paths: list[str], schema: str | None = None) -> DataFrame:
    """All records of several outputs in one read, with `source_repo`, the name of the folder that each file lies in."""
    r = spark.read.option("mode", "DROPMALFORMED")
    df = (r.schema(schema) if schema else r).json(paths)
    return df.withColumn("source_repo", F.url_decode(F.element_at(F.split(F.input_file_name(), "/"), -2)))
