"""Schemas of the artifacts, and the constraints that rows must meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SPAN = "id string, text string, meta struct<order:bigint,headingPath:array<string>>, embedding array<double>"
MANIFEST = "id string, title string, createdAt string, sourcePath string, sourceHash string, byteLength bigint, spanCount bigint, version string, format string, detection string, reader string, normalization struct<unicode:string,eol:string,blankLineCollapse:boolean>, schema struct<span:string,manifest:string,nodeMap:string>"
NODE_MAP = "book struct<id:string,title:string>, chapters map<string,struct<sectionIds:array<string>,meta:map<string,string>>>, sections map<string,struct<paragraphIds:array<string>,meta:struct<heading:string>>>, paragraphs map<string,struct<sectionId:string>>"
REPORT = "summary struct<spanCount:bigint,totalChars:bigint,avgCharsPerSpan:double,multiLineSpans:bigint,chapterCount:bigint,sectionCount:bigint>, lengthStats struct<min:struct<chars:bigint,id:string,order:bigint>,max:struct<chars:bigint,id:string,order:bigint>,p10:bigint,p50:bigint,p90:bigint>, thresholds struct<shortSpanChars:bigint,longSpanChars:bigint>, warnings struct<shortSpans:bigint,longSpans:bigint,duplicateTexts:bigint>, samples struct<shortest:string,longest:string>, provenance struct<id:string,sourceHash:string,createdAt:string,version:string,format:string,detection:string>"


def span_violations() -> Column:
    """Names of the constraints that a span row (span_id, text, ord, heading_path) breaks."""
    rules = {
        "id": F.col("span_id").isNull(),
        "text": F.coalesce(F.length("text"), F.lit(0)) < 1,
        "order": F.coalesce(F.col("ord"), F.lit(-1)) < 0,
        "headingPath": F.col("heading_path").isNull() | F.exists("heading_path", lambda x: x.isNull()),
    }
    return F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules.items()]))


def validate_spans(spans: DataFrame) -> DataFrame:
    """(corpus_id, n_spans, n_invalid)."""
    return spans.groupBy("corpus_id").agg(F.count("*").alias("n_spans"), F.count_if(F.size(span_violations()) > 0).alias("n_invalid"))
