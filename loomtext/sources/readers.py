"""Readers and writers of document collections."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import ranked

DOCUMENT = "doc_id bigint, text string, external_id string, metadata map<string,string>"
# Leading bytes of file types.
MAGIC = [
    ("application/pdf", "25504446"), ("image/png", "89504E470D0A1A0A"), ("image/jpeg", "FFD8FF"), ("image/gif", "47494638"),
    ("application/zip", "504B0304"), ("application/gzip", "1F8B"), ("application/x-ole-storage", "D0CF11E0A1B11AE1"),
    ("application/x-parquet", "50415231"), ("text/html", "3C21444F43"), ("text/xml", "3C3F786D6C"), ("image/webp", "52494646"), ("image/tiff", "49492A00"), ("image/tiff", "4D4D002A"),
    ("image/bmp", "424D"), ("application/x-bzip2", "425A68"), ("application/zstd", "28B52FFD"), ("application/x-xz", "FD377A585A00"), ("application/x-7z-compressed", "377ABCAF271C"),
    ("application/vnd.rar", "526172211A07"), ("audio/mpeg", "494433"), ("audio/flac", "664C6143"), ("audio/ogg", "4F676753"), ("application/rtf", "7B5C727466"), ("application/postscript", "25215053"),
    ("application/x-sqlite3", "53514C69746520"), ("application/x-elf", "7F454C46"), ("application/wasm", "0061736D"), ("font/woff", "774F4646"), ("font/woff2", "774F4632"),
]


def from_records(df: DataFrame, id_field: str = "id", text_field: str = "text", external_id_field: str | None = None) -> DataFrame:
    """Documents from any table; every other column goes into ``metadata`` as text, nulls left out."""
    rest = [c for c in df.columns if c not in (id_field, text_field, external_id_field)]
    pairs = F.array(*(F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in rest)) if rest else F.expr("cast(array() as array<struct<key:string,value:string>>)")
    return df.select(
        F.col(id_field).cast("long").alias("doc_id"), F.col(text_field).alias("text"),
        (F.col(external_id_field) if external_id_field else F.lit(None)).cast("string").alias("external_id"),
        F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull())).alias("metadata"),
    )


def spread(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows over all cores, by key, where a table comes in fewer than half as many splits as there are cores (few or
    unsplittable files); a table in enough splits stays as it is and nothing is moved."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if 2 * df.rdd.getNumPartitions() <= cores else df


def read_jsonl(spark: SparkSession, path: str, schema: str = "id long, text string") -> DataFrame:
    """One JSON object a line; blank lines are skipped, broken ones give nulls."""
    return spark.read.schema(schema).json(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One document a line, stripped, blank ones left out; ids count the documents from 0 in order of files and lines,
    whatever the splits."""
    t = spark.read.text(path).select(F.trim("value").alias("text"), F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("n"))
    return ranked(t.where("text <> ''"), [F.asc("f"), F.asc("b"), F.asc("n")], "r").select((F.col("r") - 1).alias("doc_id"), "text")


def read_table(spark: SparkSession, path: str, id_field: str = "id", text_field: str = "text", **fields: str) -> DataFrame:
    """Documents of a data set exported as Parquet; further names map metadata to columns.  Rows without an id column
    are numbered in order of files and rows."""
    t = spark.read.parquet(path)
    if id_field not in t.columns:
        order = t.withColumns({"_f": F.col("_metadata.file_path"), "_b": F.col("_metadata.file_block_start"), "_n": F.monotonically_increasing_id()})
        t = ranked(order, [F.asc("_f"), F.asc("_b"), F.asc("_n")], "_r").withColumn(id_field, F.col("_r") - 1).drop("_f", "_b", "_n", "_r")
    keep = [F.col(v).alias(k) for k, v in fields.items()] or [F.col(c) for c in t.columns if c not in (id_field, text_field)]
    return from_records(t.select(F.col(id_field), F.col(text_field), *keep), id_field, text_field)


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """One document a text file."""
    return spark.read.text(path, wholetext=True).select(F.xxhash64(F.col("_metadata.file_path")).alias("doc_id"), F.col("value").alias("text"), F.col("_metadata.file_name").alias("external_id"))


def write_records(docs: DataFrame, path: str, form: str = "parquet") -> None:
    """Writes documents as Parquet or JSON lines."""
    docs.write.mode("overwrite").format(form).save(path)


def to_records(docs: DataFrame) -> DataFrame:
    """One JSON object a row."""
    return docs.select(F.to_json(F.struct("*")).alias("value"))


def write_json_index(postings: DataFrame, path: str) -> None:
    """Keeps an index as JSON lines, one document with its terms and counts a line."""
    rows = postings.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("term", "tf")))).alias("terms"))
    rows.write.mode("overwrite").json(path)


def read_json_index(spark: SparkSession, path: str) -> DataFrame:
    """(term, doc_id, tf) of an index kept as JSON lines."""
    x = spark.read.schema("doc_id long, terms map<string,long>").json(path)
    return x.select(F.explode("terms").alias("term", "tf"), "doc_id").select("term", "doc_id", "tf")


def write_dictionary(words: DataFrame, path: str) -> None:
    """Keeps a set (word) or map (word, value) in order of words, so that reading a range skips the rest."""
    words.repartitionByRange("word").sortWithinPartitions("word").write.mode("overwrite").parquet(path)


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Reads a kept dictionary."""
    return spark.read.parquet(path)


def write_index(postings: DataFrame, table: str, buckets: int = 64) -> None:
    """Keeps an index as a table bucketed by term, so that searches join without moving it."""
    postings.write.mode("overwrite").bucketBy(buckets, "term").sortBy("term").saveAsTable(table)


# Media types by what a zip archive holds, and by the class id of an OLE file.
INSIDE = {"word/": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "xl/": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "ppt/": "application/vnd.openxmlformats-officedocument.presentationml.presentation", "META-INF/container.xml": "application/epub+zip"}
OLE = {"0609020000000000C000000000000046": "application/msword", "0009020000000000C000000000000046": "application/msword", "2008020000000000C000000000000046": "application/vnd.ms-excel", "1008020000000000C000000000000046": "application/vnd.ms-excel", "108D81649B4FCF1186EA00AA00B929E8": "application/vnd.ms-powerpoint"}


def looked_into(data: bytes, kind: str) -> str:
    """A closer type of an archive or OLE file: by its members, or by the class id of its first directory entry."""
    if kind == "application/zip":
        try:
            names = zipfile.ZipFile(io.BytesIO(data)).namelist()
        except zipfile.BadZipFile:
            return kind
        if "mimetype" in names[:1]:
            return zipfile.ZipFile(io.BytesIO(data)).read("mimetype")[:200].decode("ascii", "replace").strip()
        return next((mime for start, mime in INSIDE.items() if any(n.startswith(start) for n in names)), kind)
    if kind == "application/x-ole-storage":
        sector = 1 << int.from_bytes(data[30:32], "little") if len(data) >= 76 else 512
        at = 512 + int.from_bytes(data[48:52], "little") * sector if len(data) >= 76 else 512
        return OLE.get(data[at + 80 : at + 96].hex().upper(), kind)
    return kind


def sniff_deep(content: Column) -> Column:
    """Media type by leading bytes; archives and OLE files are looked into."""

    @F.pandas_udf("string")
    def run(data: pd.Series, kind: pd.Series) -> pd.Series:
        return pd.Series([k if d is None else looked_into(d, k) for d, k in zip(data, kind)], dtype="object")

    kind = sniff(content)
    return F.when(kind.isin("application/zip", "application/x-ole-storage"), run(content, kind)).otherwise(kind)


def sniff(content: Column) -> Column:
    """Media type by leading bytes; text/plain where none fits."""
    head = F.hex(F.substring(content, 1, 8))
    kind = F.lit("text/plain")
    for mime, magic in reversed(MAGIC):
        kind = F.when(head.startswith(magic), mime).otherwise(kind)
    return kind
