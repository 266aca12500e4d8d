"""Documents parsed by pluggable parsers: choice, fallback, optical recognition, and a cache by content."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A parser takes (path, content) and gives the text; what it raises is recorded with the row and fails no job.
Parser = Callable[[str, bytes], str]
PARSERS: dict[str, Parser] = {}
#: A document with less text than this is a case for optical recognition.
LEAST_TEXT = 100
PARSED = "path string, content_key string, parser string, configured_parser string, text string, error string, needs_ocr boolean"


def register(name: str, parser: Parser) -> None:
    PARSERS[name] = parser


def plain_text(path: str, content: bytes) -> str:
    """Text files; UTF-8, else windows-1252."""
    try:
        return content.decode("utf-8-sig")
    except UnicodeDecodeError:
        return content.decode("cp1252", "replace")


register("text", plain_text)


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path).select("path", "content")


def parse(files: DataFrame, configured: str, *, fallback: str | None = "text", ocr: str | None = None, config: str = "") -> DataFrame:
    """Text of each file by the configured parser, else by the fallback, else by recognition where too little text came out."""
    chosen = {n: PARSERS[n] for n in (configured, fallback, ocr) if n}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, content, key in zip(batch.path, batch.content, batch.content_key):
                used, text, errors = None, "", []
                for name in dict.fromkeys(n for n in (configured, fallback) if n):
                    try:
                        used, text = name, chosen[name](path, bytes(content))
                        break
                    except Exception as e:  # noqa: BLE001 - recorded with the row
                        errors.append(f"{name}: {e}")
                short = len(text.strip()) < LEAST_TEXT
                if short and ocr:
                    try:
                        used, text = ocr, chosen[ocr](path, bytes(content))
                    except Exception as e:  # noqa: BLE001
                        errors.append(f"{ocr}: {e}")
                out.append((path, key, used, configured, text, "; ".join(errors) or None, short))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in PARSED.split(", ")])

    keyed = files.withColumn("content_key", F.sha2(F.concat(F.col("content"), F.lit(f"|{configured}|{fallback}|{ocr}|{config}").cast("binary")), 256))
    return keyed.mapInPandas(run, PARSED)


def parse_cached(files: DataFrame, cache: DataFrame | None, configured: str, **options) -> DataFrame:
    """Like :func:`parse`, but only for content the cache lacks; hits and fresh results united."""
    if cache is None:
        return parse(files, configured, **options)
    extra = f"|{configured}|{options.get('fallback', 'text')}|{options.get('ocr')}|{options.get('config', '')}"
    keyed = files.withColumn("content_key", F.sha2(F.concat(F.col("content"), F.lit(extra).cast("binary")), 256))
    known = cache.dropDuplicates(["content_key"])
    hits = keyed.select("path", "content_key").join(known.drop("path"), "content_key").select(*[c.split()[0] for c in PARSED.split(", ")])
    fresh = parse(keyed.join(known.select("content_key"), "content_key", "left_anti").select("path", "content"), configured, **options)
    return hits.unionByName(fresh)


def label_kind(label: str) -> str:
    """Kind of block for the label a layout parser gives, by the first word it contains."""
    for word, kind in (("caption", "caption"), ("title", "heading"), ("head", "heading"), ("abstract", "abstract"), ("table", "table_region"), ("list", "list_item"), ("ref", "reference")):
        if re.search(word, label or "", re.IGNORECASE):
            return kind
    return "paragraph"
