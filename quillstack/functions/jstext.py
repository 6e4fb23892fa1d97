"""Text functions as columns, with ECMAScript string semantics.

White space, dots and ends of input differ between ECMAScript and Java regular
expressions, so the classes are spelled out here once. Lengths are UTF-16 units.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F
from pyspark.sql import types as T

from quillstack.functions import tokens as tk

_SPACES = "\\t-\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF"
WS, NOT_WS = f"[{_SPACES}]", f"[^{_SPACES}]"
DOT = "[^\\n\\r\\u2028\\u2029]"
HEADING = f"\\A(#{{1,3}}){WS}+({DOT}+)\\z"
HEADING_BEGINS = f"\\A(#{{1,3}}){WS}+{DOT}"
TOKEN = "[a-z0-9]+"


#: The characters of WS themselves.
SPACES = "".join(chr(c) for c in (*range(9, 14), 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF))


def _nfc_array(text: pa.Array) -> pa.Array:
    """Only texts that aren't ASCII are looked at one by one, and few of those change."""
    wide = np.flatnonzero(pc.fill_null(pc.invert(pc.string_is_ascii(text)), False).to_numpy(zero_copy_only=False))
    new = {int(i): unicodedata.normalize("NFC", x) for i in wide if not unicodedata.is_normalized("NFC", x := text[int(i)].as_py())}
    if not new:
        return text
    mask = np.zeros(len(text), bool)
    mask[list(new)] = True
    return pc.replace_with_mask(text, pa.array(mask), pa.array(list(new.values()), text.type))


def _plain(text: str) -> str:
    text = text.replace("\r\n", "\n").strip(SPACES)
    return re.sub("\n{3,}", "\n\n", text) if "\n\n\n" in text else text


def _split(text: str) -> list[str]:
    return [p for x in re.split("\n{2,}", text) if (p := x.strip(SPACES))]


def _each(f: Callable[[str], object], kind: pa.DataType) -> Callable[[pa.Array], pa.Array]:
    """f of every text of an array but nulls, some megabytes of text at a time."""

    def run(text: pa.Array) -> pa.Array:
        parts = tk.pieces(iter([pa.RecordBatch.from_arrays([text], names=["text"])]))
        return pa.concat_arrays([pa.array([None if x is None else f(x) for x in p.column("text").to_pylist()], kind) for p in parts] or [pa.array([], kind)])

    return run


_normalize = F.arrow_udf(lambda text: _each(_plain, pa.string())(_nfc_array(text)), T.StringType())
_paragraphs = F.arrow_udf(_each(_split, pa.list_(pa.string())), T.ArrayType(T.StringType()))


def trim(x: Column) -> Column:
    return F.btrim(x, F.lit(SPACES))


def normalize_text(x: Column) -> Column:
    """NFC, line ends, trim, and at most one blank line in a row. A lone carriage return stays."""
    return _normalize(x)


def paragraphs(x: Column) -> Column:
    """Trimmed non-empty paragraphs; their places in the array are dense."""
    return _paragraphs(x)


def utf16_length(x: Column) -> Column:
    return (F.octet_length(F.encode(x, "UTF-16BE")) / 2).cast("bigint")


def sha256(x: Column) -> Column:
    return F.sha2(x, 256)


def corpus_id(source_hash: Column) -> Column:
    return F.concat(F.lit("corpus:"), F.substring(source_hash, 1, 12))


def numbered_id(prefix: str, index: Column) -> Column:
    """1-based, padded to six digits and never cut."""
    return F.format_string(f"{prefix}:%06d", index + 1)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)/*\\z", 1)


def extension(path: Column) -> Column:
    """Without the dot; a name that only begins with a dot has none."""
    return F.regexp_extract(basename(path), "\\A.+\\.([^.]*)\\z", 1)


def detect_format(path: Column, explicit: Column | None = None) -> Column:
    found = F.lower(extension(path))
    if explicit is None:
        return found
    return F.when(F.coalesce(explicit, F.lit("")) != "", F.lower(F.regexp_replace(explicit, "\\A\\.", ""))).otherwise(found)


def extract_title(path: Column, title: Column | None = None) -> Column:
    """The given title, else the file name without its extension; a name without one gives an empty title."""
    name = basename(path)
    stem = F.when(name.rlike("\\A.+\\.[^.]*\\z"), F.regexp_replace(name, "\\.[^.]*\\z", "")).otherwise(F.lit(""))
    return stem if title is None else F.coalesce(F.nullif(title, F.lit("")), stem)


def heading_level(x: Column) -> Column:
    """1 to 3 if the whole paragraph is a heading, else 0. Of a single line the beginning tells."""
    lines = F.contains(x, F.lit("\n")) | F.contains(x, F.lit("\r")) | F.contains(x, F.lit("\u2028")) | F.contains(x, F.lit("\u2029"))
    return F.when(~F.startswith(x, F.lit("#")), 0).when(~lines, F.length(F.regexp_extract(x, HEADING_BEGINS, 1))).otherwise(F.length(F.regexp_extract(x, HEADING, 1)))


def heading_text(x: Column) -> Column:
    level = heading_level(x)
    return F.when(level > 0, trim(F.substring(x, level + 1, F.length(x))))


def tokenize(x: Column) -> Column:
    return F.regexp_extract_all(F.lower(x), F.lit(f"({TOKEN})"), F.lit(1))


def normalize_phrase(x: Column) -> Column:
    return F.array_join(tokenize(x), " ")


def parse_query_columns(q: Column) -> tuple[Column, Column]:
    """Phrases as they stand between quotes, and the tokens of the rest."""
    return F.regexp_extract_all(q, F.lit('"([^"]+)"'), F.lit(1)), tokenize(F.regexp_replace(q, '"[^"]+"', " "))


def py_tokenize(text: str) -> list[str]:
    return re.findall(TOKEN, text.lower())


def parse_query(query: str) -> tuple[list[str], list[str]]:
    """(phrases, tokens) of one query, on the driver."""
    return re.findall('"([^"]+)"', query), py_tokenize(re.sub('"[^"]+"', " ", query))


RANGES = "array<struct<start:int,end:int>>"


def phrase_ranges(normalized: Column, phrase: str) -> Column:
    """Places of a normalised phrase, left to right and not overlapping, in normalised text."""
    if not phrase:
        return F.array().cast(RANGES)
    k, none = len(phrase), F.array().cast(RANGES)
    # one walk over what stands between the places, the offset carried along
    first = F.struct(F.lit(-k).alias("at"), none.alias("hits"))
    step = lambda a, p: F.struct((a["at"] + F.length(p) + k).alias("at"), F.concat(a["hits"], F.array(F.struct((a["at"] + F.length(p) + k).alias("start"), (a["at"] + F.length(p) + 2 * k).alias("end")))).alias("hits"))
    walked = F.aggregate(F.split(normalized, phrase), first, step, lambda a: F.slice(a["hits"], 1, F.size(a["hits"]) - 1))
    return F.when(F.contains(normalized, F.lit(phrase)), walked).otherwise(none)


def heading_path_of(heading: Column) -> Column:
    """A section's heading as a path: none, or its text without the marks."""
    text = trim(F.regexp_replace(heading, f"\\A{WS}*#+{WS}*", ""))
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array(text))


def truncate(x: Column, size: int = 200) -> Column:
    """The first size UTF-16 units; half of a pair becomes the replacement character."""
    units = F.when(F.octet_length(x) == F.length(x), F.left(x, F.lit(size))).otherwise(F.decode(F.substring(F.encode(x, "UTF-16BE"), 1, 2 * size), "UTF-16BE"))
    return F.when(F.length(x) * 2 <= size, x).when(utf16_length(x) > size, F.concat(units, F.lit("..."))).otherwise(x)


def superscript_marker(n: Column) -> Column:
    return F.concat(F.lit("["), F.translate(n.cast("string"), "0123456789", "⁰¹²³⁴⁵⁶⁷⁸⁹"), F.lit("]"))


#: The natural logarithm as the C library has it, to the last bit: the JVM's differs there for some arguments, and
#: scores that are ties, or nearly, would be ranked otherwise than in SQL.
ln = F.arrow_udf(lambda x: pc.ln(x), T.DoubleType())


def round2(x: Column) -> Column:
    return F.floor(x * 100 + 0.5) / 100
