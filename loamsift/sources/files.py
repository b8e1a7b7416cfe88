"""Directory trees as tables of file records."""

from __future__ import annotations

import re
from dataclasses import dataclass, fields
from pathlib import Path
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrow import arrow
from ..functions.text import n_lines
from ..schema import language_of


@dataclass(frozen=True)
class Extraction:
    file_types: tuple[str, ...] = ()
    exclude_dirs: tuple[str, ...] = (".git", "__pycache__", "node_modules")
    exclude_dir_patterns: tuple[str, ...] = ()
    exclude_files: tuple[str, ...] = ()
    max_file_size: int = 10 << 20

    @classmethod
    def of(cls, config: dict | None) -> Extraction:
        names = {f.name for f in fields(cls)}
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in (config or {}).items() if k in names})

    @property
    def valid_patterns(self) -> list[str]:
        """The directory patterns that are regular expressions; others are skipped."""
        out = []
        for p in self.exclude_dir_patterns:
            try:
                re.compile(p)
            except re.error:
                continue
            out.append(p)
        return out


#: What the metrics scan takes, whatever the configuration.
SOURCE_TYPES = tuple("." + e for e in "bat c cc cj cpp cs css cxx go h hpp html java js json jsx kt php py r rb rs scala sh sql svelte swift ts tsx vue xml yaml yml".split())
SOURCE_EXCLUDED = (".git", ".idea", ".vscode", "__pycache__", "build", "dist", "env", "node_modules", "target", "vendor", "venv")


@arrow("string")
def decoded(contents: pa.Array) -> pa.Array:
    """UTF-8 without the bytes that aren't, line ends as line feeds."""
    return pa.array([None if c is None else c.decode("utf-8", "ignore").replace("\r\n", "\n").replace("\r", "\n") for c in contents.to_pylist()], pa.string())


def is_binary(content: Column) -> Column:
    """A NUL among the first 1024 bytes."""
    return F.coalesce(F.instr(F.hex(F.substring(content, 1, 1024)), F.lit("00")) > 0, F.lit(False)) & F.hex(F.substring(content, 1, 1024)).rlike("^(?:..)*?00")


def wanted_path(path: Column, e: Extraction) -> Column:
    """By endings (any if there are none), names to leave out, and directories by name or pattern."""
    parts = F.split(path, "/")
    dirs, name = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.element_at(parts, -1)
    ok = ~name.isin(*e.exclude_files) if e.exclude_files else F.lit(True)
    if e.file_types:
        end = F.lit(False)
        for t in e.file_types:
            end = end | F.endswith(path, F.lit(t))
        ok = ok & end
    bad = lambda d: d.isin(*e.exclude_dirs) if e.exclude_dirs else F.lit(False)
    patterns = e.valid_patterns
    return ok & ~F.exists(dirs, lambda d: bad(d) | (d.rlike("|".join(f"(?:{p})" for p in patterns)) if patterns else F.lit(False)))


def scan(spark: SparkSession, root: str, extraction: Extraction = Extraction()) -> DataFrame:
    """File records of a tree. Sizes, endings and directories are decided before any content is read.

    `created_time` is the modification time: distributed file systems keep no other.
    """
    uri = root if "://" in root or root.startswith("file:") else Path(root).resolve().as_uri()
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(uri)
    base = uri.replace("file:///", "file:/").rstrip("/") + "/"
    shown = F.replace("path", F.lit("file:///"), F.lit("file:/"))
    relative = F.regexp_replace(shown, "^" + re.escape(unquote(base)), "")
    own = raw.where(F.col("length") <= extraction.max_file_size).withColumn("relative", relative).where(wanted_path(F.col("relative"), extraction))
    name = F.element_at(F.split("relative", "/"), -1)
    extension = F.when(name.rlike(r"^.+\.[^.]+$"), F.concat(F.lit("."), F.substring_index(name, ".", -1))).otherwise("")
    time = F.unix_micros("modificationTime") / 1e6
    out = own.select(
        F.col("relative").alias("path"), F.regexp_replace(shown, "^file:/*", "/").alias("absolute_path"), name.alias("name"), extension.alias("extension"), F.col("length").alias("size"), F.sha2("content", 256).alias("hash"),
        decoded("content").alias("content"), time.alias("created_time"), time.alias("modified_time"), is_binary(F.col("content")).alias("is_binary"), language_of(extension).alias("language"),
    )
    return out.withColumn("lines", n_lines(F.col("content")))


def first_files(records: DataFrame, most: int | None) -> DataFrame:
    """At most so many records, the first in order of path: a cap that the caller asks for. None: all of them."""
    return records if most is None else records.orderBy("path").limit(most)


def source_files(spark: SparkSession, root: str) -> DataFrame:
    return scan(spark, root, Extraction(SOURCE_TYPES, SOURCE_EXCLUDED, max_file_size=1 << 40))


def safe_filename(name: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(name, r'[*?|<>:"/\\]', "_"), r"^[ .]+|[ .]+$", "")
    return F.when(s == "", "unnamed").otherwise(s)


def verify_files(records: DataFrame, expected: DataFrame) -> DataFrame:
    """path, hash, expected, verified: scanned records against a table of (path, hash); either may lack a path."""
    own = records.select("path", "hash")
    want = expected.select(F.col("path"), F.lower("hash").alias("expected"))
    return own.join(want, "path", "full").withColumn("verified", F.coalesce(F.col("hash") == F.col("expected"), F.lit(False)))


# ---- files of any file system that Spark reaches


def below(folder: str | Path, *names: str) -> str:
    """The address of something in a folder, which may be a path or a URI."""
    return "/".join([str(folder).rstrip("/") or "/", *names])


def _at(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(str(path))  # without a scheme, of the default file system
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _at(spark, path)
    return fs.exists(where)


def info(spark: SparkSession, path: str) -> dict:
    """name, extension, size, modified_time (seconds) and is_dir of a file or folder."""
    fs, where = _at(spark, path)
    s = fs.getFileStatus(where)
    name = where.getName()
    return {"name": name, "extension": Path(name).suffix, "size": s.getLen(), "modified_time": s.getModificationTime() / 1000, "is_dir": s.isDirectory()}


def listed(spark: SparkSession, folder: str, pattern: str = "*") -> list[str]:
    """Names that match a glob pattern, in order; none if the folder is not there."""
    fs, where = _at(spark, folder)
    jvm = spark.sparkContext._jvm
    return sorted(s.getPath().getName() for s in fs.globStatus(jvm.org.apache.hadoop.fs.Path(where, pattern)) or [])


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file as a whole; its folder is made."""
    fs, where = _at(spark, path)
    out = fs.create(where, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    fs, where = _at(spark, path)
    source = fs.open(where)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(source)).decode("utf-8", "ignore")
    finally:
        source.close()


def copy(spark: SparkSession, source: str, target: str) -> None:
    _transfer(spark, source, target, False)


def move(spark: SparkSession, source: str, target: str) -> None:
    _transfer(spark, source, target, True)


def _transfer(spark: SparkSession, source: str, target: str, gone: bool) -> None:
    a, b = _at(spark, source), _at(spark, target)
    if not spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy(*a, *b, gone, True, spark.sparkContext._jsc.hadoopConfiguration()):
        raise OSError(f"{source} could not be taken to {target}")


def delete(spark: SparkSession, path: str) -> bool:
    """Whether there was something to delete."""
    fs, where = _at(spark, path)
    return fs.delete(where, True)


def make_folder(spark: SparkSession, path: str) -> None:
    fs, where = _at(spark, path)
    fs.mkdirs(where)


def with_extension(path: str, extension: str) -> str:
    """The path with that ending, whether the ending was given with a dot or without."""
    e = extension if extension.startswith(".") else "." + extension
    return path if path.endswith(e) else path + e
