"""Files as tables: manifests, catalogs, vocabularies, listings, images and import tables."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE = "struct<rel:string,absPath:string,width:int,height:int>"


def manifest_pages(texts: DataFrame, column: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """(seq, rel, abs_path, width, height) of whole manifests: an object with ``pages``, or a bare array; ``keep``: columns that name the manifest."""
    held = F.coalesce(F.from_json(column, f"struct<pages:array<{PAGE}>>")["pages"], F.from_json(column, f"array<{PAGE}>"))
    pages = texts.select(*keep, F.posexplode(held).alias("seq", "p"))
    return pages.select(*keep, F.col("seq").cast("long").alias("seq"), F.col("p.rel").alias("rel"), F.col("p.absPath").alias("abs_path"), F.col("p.width").alias("width"), F.col("p.height").alias("height"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return manifest_pages(spark.read.text(path, wholetext=True))


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(id, token): a line's number is its id."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", "\\r?\\n$", ""), "\\r?\\n")).alias("id", "token"))
    return lines.select(F.col("id").cast("int").alias("id"), "token")


def read_catalog(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Entries of a JSON-lines catalog with a fixed schema, with ``seq``, their order in the file."""
    whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.filter(F.split("value", "\\r?\\n"), lambda s: s != "")).alias("seq", "line"))
    return whole.select("seq", F.from_json("line", schema).alias("e")).select("seq", "e.*")


def read_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(name, sha256) of a manifest's ``files``."""
    held = spark.read.text(path, wholetext=True).select(F.from_json("value", "struct<files:map<string,string>>")["files"].alias("f"))
    return held.select(F.explode("f").alias("name", "sha256"))


def listing(spark: SparkSession, root: str, content: bool = False, names: str | None = None) -> DataFrame:
    """(name relative to root, bytes) of all files below, in name order; ``names``: a pattern the name must match."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").split("://")[-1] + "/"
    name = F.substring_index("path", base, -1)
    out = found.select(name.alias("name"), F.col("length").alias("bytes"), *(["content"] if content else []))
    return (out.where(F.col("name").rlike(names)) if names else out).orderBy("name")


#: Names that an import audit looks at.
BINARY_NAMES = "(?i)\\.(pyd|dll|exe)$"


def import_names(data: bytes, most: int = 512) -> list[str] | None:
    """Lower-cased library names of a PE file's import table; None if it is no PE file, empty without imports."""

    def at(form: str, offset: int):
        return struct.unpack_from("<" + form, data, offset)[0]

    try:
        if data[:2] != b"MZ":
            return None
        pe = at("I", 0x3C)
        if data[pe : pe + 4] != b"PE\0\0":
            return None
        sections, optional = at("H", pe + 6), pe + 24
        magic = at("H", optional)
        directory = optional + {0x10B: 96, 0x20B: 112}[magic]
        imports = at("I", directory + 8)
        if not imports:
            return []
        table = optional + at("H", pe + 20)
        parts = [struct.unpack_from("<IIII", data, table + 40 * k + 8) for k in range(sections)]

        def place(address: int) -> int | None:
            for size, begin, raw, offset in parts:
                if begin <= address < begin + max(size, raw):
                    return address - begin + offset
            return None

        out, entry = [], place(imports)
        for k in range(most if entry is not None else 0):
            name = at("I", entry + 20 * k + 12)
            if not name:
                break
            where = place(name)
            if where is not None:
                out.append(data[where : data.index(b"\0", where)].decode("latin-1").lower())
        return out
    except (struct.error, KeyError, ValueError):
        return None


def import_edges(files: DataFrame) -> DataFrame:
    """(file, lib) of files (name, content); files that are not PE give no row."""

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame([(n, lib) for n, c in zip(rows["name"], rows["content"], strict=True) for lib in import_names(bytes(c)) or []], columns=["file", "lib"])

    return files.select("name", "content").mapInPandas(kernel, "file string, lib string")


def page_images(spark: SparkSession, pages: DataFrame, root: str) -> DataFrame:
    """Pages (rel) with their file's bytes; a page without a file gets ``error`` and goes on.  Decoding is the scorer's."""
    found = listing(spark, root, content=True).withColumnRenamed("name", "rel")
    return pages.join(found, "rel", "left").withColumn("error", F.when(F.col("content").isNull(), F.concat(F.lit("cannot read "), "rel")))
