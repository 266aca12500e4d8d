"""Tables read as they are kept: CSV of unsure encoding, workbooks, JSON lines, gold and filled tables."""

from __future__ import annotations

import json
import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.functions import values as v

BOM = "\ufeff"
#: Characters of windows-1252 where Latin-1, as which such files are read, has controls.
WESTERN = {b: c for b in range(0x80, 0xA0) if (c := bytes([b]).decode("cp1252", "ignore"))}
DESCRIPTION_COLUMNS = ("description", "improved_description", "column_description")


def file_facts(spark: SparkSession, path: str) -> tuple[list[str], list[str], bool]:
    """(files that are UTF-8, files that are not, whether quoted fields may hold line breaks), from every byte of every file.

    Lines are checked where they are read; one row per file reaches the driver.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    odd = F.expr("(length(value) - length(replace(value, '\"', ''))) % 2 = 1")
    rows = lines.groupBy("file").agg(F.bool_and(F.expr("is_valid_utf8(value)")).alias("utf8"), F.bool_or(odd).alias("odd")).collect()
    return sorted(r["file"] for r in rows if r["utf8"]), sorted(r["file"] for r in rows if not r["utf8"]), any(r["odd"] for r in rows)


def with_row_index(df: DataFrame, name: str = "row_index") -> DataFrame:
    """Rows numbered from 0 in the order they are read. Only the number of rows per partition is gathered."""
    tagged = df.withColumn("__part", F.spark_partition_id()).withColumn("__id", F.monotonically_increasing_id())
    sizes = {r["__part"]: r["n"] for r in tagged.groupBy("__part").agg(F.count("*").alias("n")).collect()}
    base, starts = 0, []
    for part in sorted(sizes):
        starts.append((part, base))
        base += sizes[part]
    offsets = df.sparkSession.createDataFrame(starts, "__part int, __base long")
    place = F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    return tagged.join(F.broadcast(offsets), "__part").select(*df.columns, (F.col("__base") + place).alias(name))


def read_csv(spark: SparkSession, path: str, *, indexed: bool = True) -> DataFrame:
    """All columns as text, nulls as empty text, quoted line breaks kept, BOM removed from the first header.

    Each file is UTF-8 if all of it is valid UTF-8, else windows-1252; a folder may hold both. Only tables with an
    open quote at the end of some line are read as whole files; all others are split like any text. Rows of UTF-8
    files are numbered before those of the others.
    """
    plain, western, quoted = file_facts(spark, path)
    options = {"header": True, "multiLine": quoted, "escape": '"', "inferSchema": False}
    odd, fixed = "".join(map(chr, WESTERN)), "".join(WESTERN.values())
    parts = []
    for files, encoding in ((plain, "utf-8"), (western, "iso-8859-1")):
        if files:
            df = spark.read.options(encoding=encoding, **options).csv(files)
            names = [c.translate(WESTERN) if files is western else c.removeprefix(BOM) for c in df.columns]
            text = lambda c: F.translate(F.coalesce(c, F.lit("")), odd, fixed) if files is western else F.coalesce(c, F.lit(""))  # noqa: B023, E731
            parts.append(df.select(*[text(F.col(f"`{c}`")).alias(n) for c, n in zip(df.columns, names)]))
    if not parts:
        parts = [spark.read.options(**options).csv(path)]
    df = parts[0]
    for more in parts[1:]:
        df = df.unionByName(more, allowMissingColumns=True)
    return with_row_index(df) if indexed and "row_index" not in df.columns else df


def read_workbook(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """The active (or named) sheet of a workbook, as text. Needs a workbook reader; a workbook fits on the driver by nature."""
    try:
        import openpyxl
    except ImportError as e:
        raise RuntimeError("reading workbooks needs openpyxl") from e
    book = openpyxl.load_workbook(path, read_only=True, data_only=True)
    rows = (book[sheet] if sheet else book.active).iter_rows(values_only=True)
    header = [str(c or "") for c in next(rows, ())]
    body = [(i, *("" if c is None else str(c) for c in row)) for i, row in enumerate(rows)]
    return spark.createDataFrame(body, T.StructType([T.StructField("row_index", T.LongType()), *(T.StructField(h, T.StringType()) for h in header)]))


def read_any(spark: SparkSession, path: str, *, sheet: str | None = None, indexed: bool = True) -> DataFrame:
    """A workbook by its suffix, else CSV."""
    if path.lower().endswith((".xlsx", ".xlsm")):
        df = read_workbook(spark, path, sheet)
        return df if indexed else df.drop("row_index")
    return read_csv(spark, path, indexed=indexed)


def is_description_row(headers: Sequence[str], values: Sequence[str]) -> bool:
    """The row under the header describes the columns: most cells are filled, long, and of several words."""
    cells = [x for h, x in zip(headers, values) if h and x and x.strip()]
    wordy = [x for x in cells if len(x.split()) >= 3]
    return len(cells) >= max(1, len(headers) // 2) and len(wordy) * 2 > len(cells)


def split_description_row(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """(the data rows, column descriptions) of an indexed table whose first row may describe its columns."""
    names = [c for c in df.columns if c != "row_index"]
    first = df.where("row_index = 0").select(*names).head()
    if first is None or not is_description_row(names, list(first)):
        return df, {}
    return df.where("row_index > 0"), dict(zip(names, first))


def read_schema(spark: SparkSession, path: str) -> DataFrame:
    """Extraction schema of a CSV, or of the sheet ``Schema`` of a workbook."""
    workbook = path.lower().endswith((".xlsx", ".xlsm"))
    return schema_columns(read_any(spark, path, sheet="Schema" if workbook else None, indexed=False))


def inline_schema(spark: SparkSession, descriptions: dict[str, str]) -> DataFrame:
    """The schema that the description row of a table is (see :func:`split_description_row`)."""
    raw = spark.createDataFrame([(c, d or "") for c, d in descriptions.items()], "column_name string, description string")
    return schema_columns(raw)


def schema_columns(raw: DataFrame) -> DataFrame:
    """``column_name``, ``description`` (the first of its columns that is filled), ``field_type``, ``allowed_values`` of a table of text."""
    from marginalia.operators.ingest import listed_values

    have = [F.expr(f"nullif(`{c}`, '')") for c in DESCRIPTION_COLUMNS if c in raw.columns]
    kind = F.expr("nullif(lower(trim(field_type)), '')") if "field_type" in raw.columns else F.lit(None).cast("string")
    allowed = F.expr(listed_values("allowed_values")) if "allowed_values" in raw.columns else F.array().cast("array<string>")
    return raw.select("column_name", F.coalesce(*have, F.lit("")).alias("description"), canonical_type(kind).alias("field_type"), allowed.alias("allowed_values"))


FIELD_TYPES = ("boolean", "categorical", "numeric", "text")
TYPE_ALIASES = {"number": "numeric", "float": "numeric", "int": "numeric", "integer": "numeric", "bool": "boolean", "category": "categorical", "enum": "categorical", "string": "text", "str": "text"}


def canonical_type(col):
    """One name for each type: numeric, boolean, categorical, text."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in TYPE_ALIASES.items() for x in kv])[col], col)


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(well-formed records, the text of malformed lines)."""
    full = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    lines = spark.read.text(path).where("trim(value) <> ''")
    parsed = lines.select("value", F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return parsed.where("r._bad is null").select(*[F.col(f"r.`{f.name}`").alias(f.name) for f in schema.fields]), parsed.where("r._bad is not null").select(F.col("value").alias("line"))


def read_gold(spark: SparkSession, path: str, *, columns: Sequence[str] | None = None) -> DataFrame:
    """Gold cells (``row_id``, ``column_name``, ``gold_value``, ``cell_id``) of a long table, or of a wide one with
    ``<column>__cell_id`` companions. Missing ids are made from the place of the row and its title."""
    df = read_any(spark, path)
    title = next((c for c in df.columns if c.lower() == "title"), None)
    if "row_id" not in df.columns:
        df = df.withColumn("row_id", F.expr(v.stable_id("row", "row_index", f"`{title}`" if title else "''")))
    if {"column_name", "gold_value"} <= set(df.columns):
        long = df.select("row_id", "column_name", "gold_value", F.col("cell_id") if "cell_id" in df.columns else F.lit("").alias("cell_id"))
    else:
        names = [c for c in df.columns if c not in ("row_id", "row_index") and not c.endswith("__cell_id")]
        cell = lambda c: F.col(f"`{c}__cell_id`") if f"{c}__cell_id" in df.columns else F.lit("")
        long = df.select("row_id", F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("gold_value"), cell(c).alias("cell_id")) for c in names])))
    long = long.withColumn("cell_id", F.when(F.col("cell_id") == "", F.expr(v.stable_id("cell", "row_id", "column_name"))).otherwise(F.col("cell_id")))
    return long.where(F.col("column_name").isin(list(columns))) if columns else long


def read_filled(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    """Proposals of a table somebody else filled: non-empty cells only."""
    return read_gold(spark, path).where(~F.expr(v.is_empty("gold_value"))).select(F.lit(run_id).alias("run_id"), "row_id", "column_name", "cell_id", F.col("gold_value").alias("proposed_value"), F.lit("value_proposed").alias("proposal_status"))


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where, jvm


def exists(spark: SparkSession, path: str) -> bool:
    fs, where, _ = _file_system(spark, path)
    return fs.exists(where)


def subdirectories(spark: SparkSession, path: str) -> list[str]:
    """Folders directly below ``path``, in order, on whatever file system it lies."""
    fs, where, _ = _file_system(spark, path)
    return sorted(str(s.getPath().toUri().getPath() if s.getPath().toUri().getScheme() == "file" else s.getPath().toString()) for s in fs.listStatus(where) if s.isDirectory())


def run_directories(spark: SparkSession, paths: Sequence[str] = (), root: str | None = None) -> list[str]:
    """Directories of runs, given one by one or found below ``root`` by their proposals; both at once are refused."""
    if paths and root:
        raise ValueError("give run paths or a root, not both")
    if not paths and not root:
        raise ValueError("give run paths or a root")
    if missing := [p for p in paths if not exists(spark, p)]:
        raise FileNotFoundError(f"no such run: {missing}")
    found = list(paths) or [p for p in subdirectories(spark, root) if exists(spark, f"{p}/proposals/proposals.jsonl")]
    if not found:
        raise FileNotFoundError("no run matches")
    return found


def find_tables(spark: SparkSession, root: str, name: str = "*_filled.csv") -> list[str]:
    """Companion tables anywhere below ``root``, in order."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name).load(root).select("path")
    return sorted(r["path"].removeprefix("file:") for r in files.collect())  # one row per file


def find_upwards(spark: SparkSession, start: str, name: str, levels: int = 3, explicit: str | None = None) -> str | None:
    """A side-car file: the explicit path, else the nearest of that name in ``start`` or up to ``levels`` parents; null if none."""
    if explicit:
        return explicit if exists(spark, explicit) else None
    folder = start.rstrip("/")
    for _ in range(levels + 1):
        if exists(spark, f"{folder}/{name}"):
            return f"{folder}/{name}"
        folder = os.path.dirname(folder)
    return None


def whole_texts(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``directory`` and ``text`` of small files read whole."""
    text = spark.read.text(list(paths), wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    return text.select("file", F.regexp_replace("file", "^file:(//)?(?=/)", "").alias("path"), "text")


# Files a run must and may have, versions that are known, fields a run of the evaluation must give.
REQUIRED_FILES = ("run.json", "proposals/proposals.jsonl")
OPTIONAL_FILES = ("config.snapshot.json", "inputs/input_summary.json", "summaries/run_summary.json", "summaries/reviewer_summary.json")
KNOWN_VERSIONS, KNOWN_EVIDENCE_VERSIONS = ("main_run_bundle",), ("main_evidence",)
PROVENANCE = {
    "gold_table_hash": ("gold_table_hash", "gold_table_content_hash", "gold_content_hash"), "gold_table_snapshot_path": ("gold_table_snapshot_path", "gold_snapshot_path"),
    "masked_table_hash": ("masked_table_hash", "masked_working_table_hash", "masked_table_content_hash"), "masked_table_snapshot_path": ("masked_table_snapshot_path", "masked_working_table_path", "masked_working_table_snapshot_path", "masked_snapshot_path"),
}
SECTIONS = ("", "eval.", "provenance.")
REQUIRED = ("run_id", "row_id", "column_name")


def first_present(json: str, keys: Sequence[str], sections: Sequence[str] = SECTIONS):
    """The first key of a JSON text that is there and not blank, in the order of the sections and keys."""
    return F.coalesce(*[F.expr(f"nullif(trim(get_json_object({json}, '$.{section}{key}')), '')") for section in sections for key in keys])


def read_run_metadata(spark: SparkSession, directories: Sequence[str]) -> DataFrame:
    """One row per run: ``run_id``, ``schema_version``, ``run_mode``, ``text_model_id``, ``directory``, the provenance
    fields, and ``missing_provenance`` of runs of the evaluation. Nested sections are searched behind the top level."""
    raw = whole_texts(spark, [f"{d}/run.json" for d in directories]).withColumn("directory", F.regexp_replace("path", "/run\\.json$", ""))
    of = lambda *keys: first_present("text", keys)
    out = raw.select("directory", of("run_id").alias("run_id"), of("artifact_schema_version").alias("schema_version"), F.lower(of("run_mode")).alias("run_mode"), of("provider_text_model_id").alias("text_model_id"), *[of(*keys).alias(name) for name, keys in PROVENANCE.items()])
    missing = F.array_compact(F.array(*[F.when(F.col(name).isNull(), F.lit(name)) for name in PROVENANCE]))
    return out.withColumn("missing_provenance", F.when(F.col("run_mode") == "eval", missing).otherwise(F.array().cast("array<string>")))


def read_runs(spark: SparkSession, directories: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(proposals of all valid runs with the metadata of their run, rule violations).

    Invalid is a run without a required file, of an unknown version, or of the evaluation without provenance; its
    proposals are left out and the rule is reported. Optional files that are missing, malformed lines and proposals
    without the fields needed to join are reported, too.
    """
    have = {d: [f for f in (*REQUIRED_FILES, *OPTIONAL_FILES) if exists(spark, f"{d}/{f}")] for d in directories}
    absent = [("required file missing", f"{d}/{f}") for d, h in have.items() for f in REQUIRED_FILES if f not in h] + [("optional file missing", f"{d}/{f}") for d, h in have.items() for f in OPTIONAL_FILES if f not in h]
    whole = [d for d, h in have.items() if set(REQUIRED_FILES) <= set(h)]
    errors = spark.createDataFrame(absent, "rule string, detail string")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in (*REQUIRED, "cell_id", "proposed_value", "proposal_status", "evidence_status", "review_bucket", "field_type")])
    if not whole:
        empty = T.StructType([*schema.fields, *(T.StructField(c, T.StringType()) for c in ("schema_version", "text_model_id", "directory"))])
        return spark.createDataFrame([], empty), errors
    meta = read_run_metadata(spark, whole)
    unknown = meta.where(~F.coalesce(F.col("schema_version").isin(*KNOWN_VERSIONS), F.lit(False))).select(F.lit("unknown version").alias("rule"), F.concat_ws("=", "directory", "schema_version").alias("detail"))
    bare = meta.where(F.size("missing_provenance") > 0).select(F.lit("provenance missing").alias("rule"), F.concat(F.col("directory"), F.lit(": "), F.array_join("missing_provenance", ", ")).alias("detail"))
    valid = meta.where(F.col("schema_version").isin(*KNOWN_VERSIONS) & (F.size("missing_provenance") == 0)).select("run_id", "schema_version", "text_model_id", "directory")
    good, bad = read_json_lines(spark, [f"{d}/proposals/proposals.jsonl" for d in whole], schema)
    orphans = good.where("run_id is not null").join(meta.select("run_id"), "run_id", "left_anti").select(F.lit("unknown run").alias("rule"), F.col("run_id").alias("detail")).distinct()
    joined = good.join(valid, "run_id")
    missing = good.where(" or ".join(f"{c} is null" for c in REQUIRED)).select(F.lit("join field missing").alias("rule"), F.to_json(F.struct(*REQUIRED)).alias("detail"))
    for more in (unknown, bare, missing, orphans, bad.select(F.lit("malformed line").alias("rule"), F.col("line").alias("detail"))):
        errors = errors.unionByName(more)
    return joined.where(" and ".join(f"{c} is not null" for c in REQUIRED)), errors


EVIDENCE_FIELDS = "evidence_id string, id string, proposal_id string, pdf_id string, page int, page_number int, quote_text string, quote string, page_text string, page_content string, source_text string, evidence_schema_version string"


def read_evidence(spark: SparkSession, directories: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(evidence kept beside the runs, malformed or unknown records): ``directory``, ``evidence_id``, ``proposal_id``,
    ``pdf_id``, ``page``, ``quote_text``, ``page_text``. Of one id within a run one record counts, JSON files before lines."""
    lines = [f"{d}/evidence/evidence.jsonl" for d in directories if exists(spark, f"{d}/evidence/evidence.jsonl")]
    lists = [f"{d}/evidence/evidence.json" for d in directories if exists(spark, f"{d}/evidence/evidence.json")]
    raw = spark.createDataFrame([], "directory string, value string, source int")
    folder = lambda c: F.regexp_replace(F.regexp_replace(c, "^file:(//)?(?=/)", ""), "/evidence/[^/]*$", "")
    if lines:
        raw = raw.unionByName(spark.read.text(lines).select(folder(F.col("_metadata.file_path")).alias("directory"), "value", F.lit(1).alias("source")).where("trim(value) <> ''"))
    if lists:
        items = whole_texts(spark, lists).select(folder(F.col("path")).alias("directory"), F.explode(F.from_json("text", "array<string>")).alias("value"), F.lit(0).alias("source"))
        raw = raw.unionByName(items)
    parsed = raw.withColumn("r", F.from_json("value", EVIDENCE_FIELDS + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})).withColumn("key", F.expr("coalesce(r.evidence_id, r.id)"))
    known = F.coalesce(F.col("r.evidence_schema_version").isin(*KNOWN_EVIDENCE_VERSIONS), F.lit(False))
    ok = F.col("r._bad").isNull() & F.col("key").isNotNull() & known
    kept = parsed.where(ok).groupBy("directory", "key").agg(F.min(F.struct("source", "r")).alias("x"))
    evidence = kept.select(
        "directory", F.col("key").alias("evidence_id"), "x.r.proposal_id", "x.r.pdf_id", F.coalesce("x.r.page", "x.r.page_number").alias("page"), F.coalesce("x.r.quote_text", "x.r.quote").alias("quote_text"),
        F.coalesce(*[F.nullif(F.col(f"x.r.{c}"), F.lit("")) for c in ("page_text", "page_content", "source_text")]).alias("page_text"),
    )
    bad = parsed.where(~ok).select(F.when(F.col("r._bad").isNotNull(), "malformed record").when(F.col("key").isNull(), "no id").otherwise("unknown version").alias("rule"), F.col("value").alias("detail"))
    return evidence, bad


def read_page_texts(spark: SparkSession, directories: Sequence[str]) -> DataFrame:
    """``directory``, ``page``, ``page_text`` of the page side-cars of runs: an object from page to text. The first of the three names counts."""
    found = [next((f for f in (f"{d}/evidence/{n}.json" for n in ("page_text", "page_texts", "pages")) if exists(spark, f)), None) for d in directories]
    paths = [f for f in found if f]
    if not paths:
        return spark.createDataFrame([], "directory string, page int, page_text string")
    raw = whole_texts(spark, paths).select(F.regexp_replace("path", "/evidence/[^/]*$", "").alias("directory"), F.explode(F.from_json("text", "map<string,string>")).alias("page", "page_text"))
    return raw.select("directory", F.expr("try_cast(page as int)").alias("page"), "page_text").where("page is not null and trim(page_text) <> ''")


def joined_evidence(embedded: DataFrame, sidecar: DataFrame, references: DataFrame, proposal: str = "proposal_id", key: str = "evidence_id") -> DataFrame:
    """Evidence of each proposal: what is embedded in it, and what it refers to beside it; an id counts once, the embedded first."""
    beside = references.select(proposal, key).distinct().join(sidecar.drop(proposal), key)
    both = embedded.withColumn("__o", F.lit(0)).unionByName(beside.withColumn("__o", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in (proposal, key, "__o")]
    return both.groupBy(proposal, key).agg(F.min(F.struct("__o", *rest)).alias("x")).select(proposal, key, *[F.col(f"x.{c}").alias(c) for c in rest], (F.col("x.__o") == 0).alias("is_embedded"))


def read_summaries(spark: SparkSession, root: str, name: str = "run_summary.json") -> DataFrame:
    """One wide row per run of the summaries below ``root``: scalars as text, nested keys joined by points."""
    files = [f"{p}/{name}" for p in subdirectories(spark, root) if exists(spark, f"{p}/{name}")]
    if not files:
        return spark.createDataFrame([], "directory string, key string, value string")
    flat = F.udf(_flat, T.MapType(T.StringType(), T.StringType()))  # one small file per run
    return whole_texts(spark, files).select(F.regexp_replace("path", "/[^/]*$", "").alias("directory"), F.explode(flat("text")).alias("key", "value"))


def _flat(text: str) -> dict[str, str]:
    out: dict[str, str] = {}

    def walk(prefix: str, value: object) -> None:
        if isinstance(value, dict):
            for k, x in value.items():
                walk(f"{prefix}.{k}" if prefix else str(k), x)
        elif value is not None:
            out[prefix] = json.dumps(value) if isinstance(value, (list, bool)) else str(value)

    try:
        walk("", json.loads(text))
    except ValueError:
        pass
    return out


DEFAULT_EXCLUDED = ("Title", "Authors", "Publication Year", "DOI", "Journal")


def read_eval_schema(spark: SparkSession, path: str | None) -> tuple[DataFrame, dict]:
    """(columns, settings) of an evaluator's schema: a list of columns or an object by name. A schema is small by nature.

    Without a path there are no columns and the columns of metadata are excluded from scores, as they always are.
    An unknown field type and a column without a name raise ``ValueError``.
    """
    payload = json.loads(whole_texts(spark, [path]).first()["text"]) if path else {}
    columns = payload.get("columns") or {}
    pairs = [(c.get("name"), c) for c in columns] if isinstance(columns, list) else list(columns.items())
    tolerance = lambda t: (float(t.get("abs_tol", t.get("abs", 0.0))), float(t.get("rel_tol", t.get("rel", 0.0)))) if t else (None, None)
    rows = []
    for name, c in pairs:
        if not isinstance(name, str) or not name.strip():
            raise ValueError("a column of the schema has no name")
        kind = c.get("field_type")
        plain = TYPE_ALIASES.get(str(kind).strip().lower(), str(kind).strip().lower()) if kind else None
        if plain is not None and plain not in FIELD_TYPES:
            raise ValueError(f"unknown field type {kind!r} of {name!r}")
        rows.append((name, plain, c.get("description"), [str(x) for x in c.get("allowed_values") or ()], {str(k): str(x) for k, x in (c.get("aliases") or {}).items()}, c.get("scoring_policy"), *tolerance(c.get("numeric_tolerance"))))
    table = spark.createDataFrame(rows, "column_name string, field_type string, description string, allowed_values array<string>, aliases map<string,string>, scoring_policy string, abs_tol double, rel_tol double")
    low, high = tolerance(payload.get("global_numeric_tolerance") or payload.get("numeric_tolerance"))
    texts = lambda key: [str(x) for x in payload.get(key) or () if str(x).strip()]
    return table, {"abs_tol": low or 0.0, "rel_tol": high or 0.0, "scored": texts("scored_columns") or texts("target_columns"), "excluded": list(dict.fromkeys([*DEFAULT_EXCLUDED, *texts("excluded_columns")]))}


def is_scored(column, settings: dict):
    """Whether a column counts: it is among the scored ones where those are listed, else not among the excluded."""
    return column.isin(settings["scored"]) if settings["scored"] else ~column.isin(settings["excluded"])
