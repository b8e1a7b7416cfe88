"""The file record, and how the documents table plays it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.patterns import LANGUAGES
from .functions.text import n_lines

RECORD = "path string, absolute_path string, name string, extension string, size long, hash string, content string, lines int, created_time double, modified_time double, is_binary boolean, language string"

_ITEM = "name:string,line:int,type:string"
STRUCTURE = (
    "struct<classes:array<struct<name:string,line:int,type:string,bases:array<string>,methods:array<string>,docstring:string>>,"
    "functions:array<struct<name:string,line:int,type:string,args:array<string>,returns:string,docstring:string,is_async:boolean>>,"
    f"methods:array<struct<{_ITEM}>>,imports:array<struct<module:string,name:string,alias:string,line:int,type:string>>,"
    f"includes:array<struct<header:string,line:int,type:string>>,variables:array<struct<{_ITEM}>>,"
    "total_lines:int,non_empty_lines:int,language:string,complexity:int>"
)


def language_of(extension: Column) -> Column:
    """The language of a file extension, 'unknown' for others and null."""
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(table[F.lower(extension)], F.lit("unknown"))


def file_records(docs: DataFrame) -> DataFrame:
    """The documents table as file records. The modification time stands in by the document's number; `ord` is the row's order."""
    text = F.col("text")
    return docs.select(
        F.concat(F.coalesce("source", F.lit("unknown")), F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.lit(".txt")).alias("path"),
        F.lit(".txt").alias("extension"),
        F.octet_length(text).cast("long").alias("size"),
        text.alias("content"),
        n_lines(text).alias("lines"),
        F.col("doc_id").cast("double").alias("modified_time"),
        F.lit(False).alias("is_binary"),
        F.coalesce("lang", F.lit("unknown")).alias("language"),
        F.col("doc_id").alias("ord"),
        F.coalesce("source", F.lit("unknown")).alias("source_repo"),
    )
