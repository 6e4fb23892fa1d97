"""Artifacts: one corpus as spans.jsonl, manifest.json, nodeMap.json and buildReport.json,
or many corpora as Parquet tables partitioned by corpus."""

from __future__ import annotations

import json
import os
from typing import NamedTuple

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from quillstack.sources import schemas


class Artifacts(NamedTuple):
    manifest: dict
    spans: DataFrame  # id, text, meta, embedding
    node_map: dict | None
    report: dict | None


def wire_spans(spans: DataFrame, embeddings: DataFrame | None = None) -> DataFrame:
    """Spans in the wire format, from (corpus_id, span_id, ord, text, heading_path)."""
    out = spans if embeddings is None else spans.join(embeddings, ["corpus_id", "span_id"], "left")
    columns = [F.col("span_id").alias("id"), "text", F.struct(F.col("ord").alias("order"), F.col("heading_path").alias("headingPath")).alias("meta")]
    return out.select(*columns, *(["embedding"] if embeddings is not None else []))


def write_spans(spans: DataFrame, path: str, name: str = "spans.jsonl") -> str:
    """One compact object a line, in order, as one file; fields without a value are left out."""
    os.makedirs(path, exist_ok=True)
    target = os.path.join(path, name)
    lines = spans.orderBy("meta.order").select(F.to_json(F.struct("*"), {"ignoreNullFields": "true"}).alias("value"))
    with open(target, "w", encoding="utf-8") as f:
        f.writelines(row.value + "\n" for row in lines.toLocalIterator())
    return target


def checked(value: dict, schema: str, what: str) -> dict:
    """value without unknown keys; raises where a key is missing or of another type."""

    def walk(x: object, kind: T.DataType, at: str) -> object:
        if isinstance(kind, T.StructType):
            if not isinstance(x, dict):
                raise ValueError(f"{what}: {at or 'value'} must be an object")
            missing = [f.name for f in kind if f.name not in x]
            if missing:
                raise ValueError(f"{what}: missing {', '.join(at + m for m in missing)}")
            return {f.name: walk(x[f.name], f.dataType, f"{at}{f.name}.") for f in kind}
        if isinstance(kind, T.MapType):
            if not isinstance(x, dict):
                raise ValueError(f"{what}: {at} must be an object")
            return {k: walk(v, kind.valueType, f"{at}{k}.") for k, v in x.items()}
        if isinstance(kind, T.ArrayType):
            if not isinstance(x, list):
                raise ValueError(f"{what}: {at} must be an array")
            return [walk(v, kind.elementType, at) for v in x]
        ok = {T.StringType: str, T.LongType: int, T.BooleanType: bool, T.DoubleType: (int, float)}[type(kind)]
        if not isinstance(x, ok) or (isinstance(x, bool) and not isinstance(kind, T.BooleanType)):
            raise ValueError(f"{what}: {at[:-1]} must be {kind.simpleString()}")
        if isinstance(x, int) and not isinstance(x, bool) and x < 0:
            raise ValueError(f"{what}: {at[:-1]} must not be negative")
        return x

    out = walk(value, T.StructType.fromDDL(schema), "")
    if isinstance(out, dict) and out.get("detection", "auto") not in ("auto", "flag"):
        raise ValueError(f"{what}: detection must be auto or flag")
    return out


def write_json(value: dict | Row, schema: str, path: str, name: str) -> str:
    value = value.asDict(recursive=True) if isinstance(value, Row) else value
    os.makedirs(path, exist_ok=True)
    target = os.path.join(path, name)
    with open(target, "w", encoding="utf-8") as f:
        f.write(json.dumps(checked(value, schema, name), indent=2, ensure_ascii=False))
    return target


def _load_json(path: str, name: str, schema: str, required: bool) -> dict | None:
    target = os.path.join(path, name)
    if not os.path.exists(target):
        if required:
            raise FileNotFoundError(f"{name} not found in {path}")
        return None
    try:
        with open(target, encoding="utf-8") as f:
            return checked(json.load(f), schema, name)
    except ValueError as e:
        raise ValueError(f"Failed to load {name}: {e}") from e


def load(spark: SparkSession, path: str) -> Artifacts:
    """The artifacts of a directory; manifest and spans must be there. The first bad span is named by its line."""
    if not os.path.exists(path):
        raise FileNotFoundError(f"Directory not found: {path}")
    if not os.path.isdir(path):
        raise NotADirectoryError(f"Not a directory: {path}")
    manifest = _load_json(path, "manifest.json", schemas.MANIFEST, True)
    target = os.path.join(path, "spans.jsonl")
    if not os.path.exists(target):
        raise FileNotFoundError(f"spans.jsonl not found in {path}")
    # wholetext keeps the line numbers, blank lines in between included
    text = spark.read.text(target, wholetext=True).select(F.regexp_replace("value", "\\A\\s+|\\s+\\z", "").alias("value"))
    lines = text.select(F.posexplode(F.split("value", "\n")).alias("line", "value"))
    parsed = lines.withColumn("s", F.from_json("value", schemas.SPAN + ", _bad string", {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}))
    s = F.col("s")
    bad = parsed.filter(s.isNull() | s["_bad"].isNotNull() | s["id"].isNull() | (F.coalesce(F.length(s["text"]), F.lit(0)) < 1) | (F.coalesce(s["meta"]["order"], F.lit(-1)) < 0) | s["meta"]["headingPath"].isNull())
    if first := bad.orderBy("line").select("line").head():
        raise ValueError(f"Failed to load spans.jsonl: Invalid span at line {first.line + 1}")
    last = F.row_number().over(W.partitionBy("s.id").orderBy(F.desc("line")))
    spans = parsed.withColumn("n", last).filter("n = 1").select("s.id", "s.text", "s.meta", "s.embedding")
    return Artifacts(manifest, spans, _load_json(path, "nodeMap.json", schemas.NODE_MAP, False), _load_json(path, "buildReport.json", schemas.REPORT, False))


def write_tables(path: str, **tables: DataFrame) -> None:
    """Any number of corpora: one Parquet table each, clustered by corpus."""
    for name, table in tables.items():
        table.sortWithinPartitions("corpus_id").write.mode("overwrite").parquet(os.path.join(path, name))
