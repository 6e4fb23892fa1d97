"""Sources: files and tables to normalised documents with hashes and titles."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillstack import __version__
from quillstack.functions import jstext as js

VERSION_SCHEMA = {"span": "1.0.0", "manifest": "1.0.0", "nodeMap": "1.0.0"}


class TextReader:
    """Plain text and Markdown, read as UTF-8; bad bytes become U+FFFD."""

    name = "text"
    formats = ("txt", "text", "md", "markdown")

    def can_handle(self, fmt: str) -> bool:
        return fmt.lower() in self.formats

    def extract(self, spark: SparkSession, paths: list[str]) -> DataFrame:
        """(path, text, byte_length)."""
        files = spark.read.format("binaryFile").load(paths)
        return files.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"), F.col("length").alias("byte_length"))


READERS: list[TextReader] = [TextReader()]


def supported_formats() -> list[str]:
    return sorted({f for r in READERS for f in r.formats})


def reader_for(fmt: str) -> TextReader:
    for reader in READERS:
        if reader.can_handle(fmt):
            return reader
    raise ValueError(f"No reader found for format '{fmt}'.\nSupported formats: {', '.join(supported_formats())}")


def register(reader: TextReader, first: bool = False) -> Callable[[], None]:
    """Adds a reader; returns what takes it out again."""
    READERS.insert(0 if first else len(READERS), reader)
    return lambda: READERS.remove(reader)


def detect_format(path: str, explicit: str | None = None) -> str:
    """On the driver, for one path."""
    if explicit:
        return explicit.lower().removeprefix(".")
    return os.path.splitext(os.path.basename(path))[1].lower().removeprefix(".")


def enriched(raw: DataFrame, explicit_format: str | None = None, title: str | None = None, reader: str = "text") -> DataFrame:
    """Raw documents (path, text, byte_length) with normalised text, hash, corpus_id, format and title."""
    given = F.lit(explicit_format) if explicit_format else None
    out = raw.withColumn("text", js.normalize_text(F.col("text"))).withColumn("source_hash", js.sha256(F.col("text")))
    return out.select(
        js.corpus_id(F.col("source_hash")).alias("corpus_id"), "path", "text", "source_hash", F.col("byte_length").cast("bigint").alias("byte_length"),
        js.detect_format(F.col("path"), given).alias("format"), F.lit("flag" if explicit_format else "auto").alias("detection"),
        js.extract_title(F.col("path"), F.lit(title) if title else None).alias("title"), F.lit(reader).alias("reader"),
    )


def read_files(spark: SparkSession, paths: list[str] | str, explicit_format: str | None = None, title: str | None = None) -> DataFrame:
    """Enriched documents of files; every file's format must have a reader."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    reader = reader_for(detect_format(paths[0], explicit_format))
    for p in paths[1:]:
        reader_for(detect_format(p, explicit_format))
    return enriched(reader.extract(spark, [os.path.abspath(p) for p in paths]), explicit_format, title, reader.name)


def manifests(docs: DataFrame, span_counts: DataFrame) -> DataFrame:
    """One row a corpus in the wire format; span_counts is (corpus_id, n)."""
    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return docs.join(span_counts, "corpus_id").select(
        "corpus_id", F.col("corpus_id").alias("id"), "title", now.alias("createdAt"), F.col("path").alias("sourcePath"), F.col("source_hash").alias("sourceHash"),
        F.col("byte_length").alias("byteLength"), F.col("n").alias("spanCount"), F.lit(__version__).alias("version"), "format", "detection", "reader",
        F.struct(F.lit("NFC").alias("unicode"), F.lit("LF").alias("eol"), F.lit(True).alias("blankLineCollapse")).alias("normalization"),
        F.struct(*[F.lit(v).alias(k) for k, v in VERSION_SCHEMA.items()]).alias("schema"),
    )
