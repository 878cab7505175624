"""Where images come from: text columns, binary files, text graphs, symbol tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.runtime import table

IMAGE = "image_id long, bytes binary"


def from_column(df: DataFrame, image_id: Column, content: Column) -> DataFrame:
    """Images from the UTF-8 bytes of a text column, or a binary one; null contents make no image."""
    return df.where(content.isNotNull()).select(image_id.cast("long").alias("image_id"), content.cast("binary").alias("bytes"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_column(table(spark, sf_dir, "documents"), F.col("doc_id"), F.col("text"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_column(table(spark, sf_dir, "pages"), F.col("page_id"), F.col("html"))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An image for each turn."""
    return from_column(table(spark, sf_dir, "conversations"), F.col("conv_id") * 1000 + F.col("turn"), F.col("text"))


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 32 bytes of each document's SHA-256, which take all values."""
    return from_column(table(spark, sf_dir, "documents").where("text IS NOT NULL"), F.col("doc_id"), F.unhex(F.sha2("text", 256)))


CORPORA = {"documents": documents, "pages": pages, "conversations": conversations, "hashes": hashes}


def from_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Raw images from all files below a folder; image_id is a hash of the path, which is kept."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select(F.xxhash64("path").alias("image_id"), F.col("content").alias("bytes"), "path", F.col("length").alias("n_bytes"))


def image_table(images: DataFrame, isa: str = "t8") -> DataFrame:
    """What is known of each image.  The byte order is not recorded."""
    return images.select("image_id", F.lit(isa).alias("arch"), F.lit(None).cast("string").alias("endian"), F.lit(1).cast("long").alias("main_entry"), F.octet_length("bytes").cast("long").alias("n_bytes"))


def segments(images: DataFrame, at: str | None = None) -> DataFrame:
    """(image_id, seg_id, low, high): one executable segment per image, or two halves."""
    n = F.octet_length("bytes").cast("long")
    if at is None:
        return images.select("image_id", F.lit(0).alias("seg_id"), F.lit(1).cast("long").alias("low"), n.alias("high"))
    half = F.floor(n / 2)
    parts = F.array(F.struct(F.lit(0).alias("seg_id"), F.lit(1).cast("long").alias("low"), half.alias("high")), F.struct(F.lit(1).alias("seg_id"), (half + 1).alias("low"), n.alias("high")))
    return images.select("image_id", F.explode(parts).alias("s")).select("image_id", "s.*")


def parse_graph(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst) of lines ``src-dst``; a line with one address is a vertex: (v, v)."""
    line = spark.read.text(path).where("trim(value) <> ''")
    ends = F.split(F.trim("value"), "-")
    return line.select(ends[0].cast("long").alias("src"), F.coalesce(F.get(ends, F.lit(1)), ends[0]).cast("long").alias("dst"))


def function_entrances(insn: DataFrame) -> DataFrame:
    """Ground truth of the synthetic images: the first address, and every address after a newline."""
    after = insn.where("word = 10 AND addr < n").select("image_id", (F.col("addr") + 1).alias("addr"))
    return insn.where("addr = 1").select("image_id", "addr").unionByName(after)


def symbols(spark: SparkSession, path: str) -> DataFrame:
    """(name, addr, size) of text lines ``(name addr size)`` with hexadecimal numbers, as a symbol dump has them."""
    part = r"^\(\s*(\S+)\s+(?:0x)?([0-9a-fA-F]+)\s+(?:0x)?([0-9a-fA-F]+)\s*\)"
    number = lambda k: F.conv(F.regexp_extract("value", part, k), 16, 10).cast("long")
    return spark.read.text(path).where(F.col("value").rlike(part)).select(F.regexp_extract("value", part, 1).alias("name"), number(2).alias("addr"), number(3).alias("size"))
