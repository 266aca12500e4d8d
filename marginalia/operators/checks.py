"""Checks and coercions of records: answers by a JSON schema, table schemas, generic texts, preflight of gold tables."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.functions import values as v

# Words for nothing, and words a model uses for the state of an answer.
NOTHING = ("", "n/a", "na", "none", "null", "not applicable", "not_applicable")
STATES = {**dict.fromkeys(("found", "yes", "present", "visible", "clear", "success", "succeeded"), "found"), "inferred": "inferred", "possible": "inferred", "unclear": "unclear"}
PROPOSED = ("propose", "proposed", "propose_value", "proposed_value")
JSON_TYPES = {"null": type(None), "string": str, "integer": int, "number": (int, float), "boolean": bool, "object": dict, "array": list}


def _types(schema: Mapping) -> list[str]:
    kind = schema.get("type")
    return [] if kind is None else [str(x) for x in (kind if isinstance(kind, list) else [kind])]


def text_of(value: object, joiner: str = "\n") -> str | None:
    """A value as one text: lists joined, the ``text`` of an object or else its JSON; null if blank."""
    if isinstance(value, list):
        out = joiner.join(x for x in (text_of(i, joiner) for i in value) if x)
    elif isinstance(value, dict):
        if "text" in value:
            return text_of(value["text"], joiner)
        out = json.dumps(value, ensure_ascii=False, sort_keys=True)
    else:
        out = "" if value is None else str(value)
    return out.strip() or None


def coerced(value: object, schema: Mapping) -> object:
    """``value`` brought to what its schema asks for where that is plain: words for nothing, digits as numbers, texts of
    other values, states by their synonyms, required fields that may be empty."""
    if value is None:
        return None
    kinds = _types(schema)
    if isinstance(value, str) and None in schema.get("enum", ()) and value.strip().lower() in NOTHING:
        return None
    if isinstance(value, str) and "integer" in kinds and value.strip().isdigit():
        return int(value.strip())
    if "string" in kinds and not isinstance(value, str) and (text := text_of(value)) is not None:
        return text
    if isinstance(value, list) and "array" in kinds:
        return [coerced(x, schema.get("items") or {}) for x in value]
    if not isinstance(value, dict):
        return value
    fields = schema.get("properties") or {}
    out = {k: coerced(x, fields[k]) if isinstance(fields.get(k), dict) else x for k, x in value.items()}
    if isinstance(fields.get("state"), dict) and {"found", "unclear"} <= set(fields["state"].get("enum", ())):
        out["state"] = _state(out.get("state"), out.get("proposed_value"))
    for name in schema.get("required", ()):
        own = _types(fields[name]) if isinstance(fields.get(name), dict) else []
        if name not in out and own:
            if "null" in own:
                out[name] = None
            elif "array" in own:
                out[name] = []
            elif "boolean" in own:
                out[name] = False
    return out


def _state(value: object, proposed: object) -> object:
    by_value = "found" if text_of(proposed) else "unclear"
    if not isinstance(value, str):
        return by_value if value is None else value
    plain = re.sub(r"[^a-z0-9]+", "_", value.strip().lower()).strip("_")
    return by_value if plain in PROPOSED else STATES.get(plain, value)


def violation(value: object, schema: Mapping, path: str = "$") -> str | None:
    """The first rule of the schema the value breaks, with its path; null if none."""
    kinds = _types(schema)
    fits = lambda k: isinstance(value, JSON_TYPES.get(k, object)) and not (isinstance(value, bool) and k in ("integer", "number"))
    if kinds and not any(map(fits, kinds)):
        return f"{path}: expected {', '.join(kinds)}"
    if "enum" in schema and value not in schema["enum"]:
        return f"{path}: not one of the values"
    if isinstance(value, dict):
        for name in schema.get("required", ()):
            if name not in value:
                return f"{path}: {name} is missing"
        inner = [violation(value[k], s, f"{path}.{k}") for k, s in (schema.get("properties") or {}).items() if k in value]
        return next((x for x in inner if x), None)
    if isinstance(value, list) and "items" in schema:
        return next((x for i, item in enumerate(value) if (x := violation(item, schema["items"], f"{path}[{i}]"))), None)
    return None


def validated_json(df: DataFrame, text: str, schema: Mapping, *, value: str = "json", error: str = "error") -> DataFrame:
    """``df`` with the JSON of ``text`` coerced by ``schema`` (null if it breaks it) and the rule it breaks. A schema is
    recursive, so this is one Arrow map; rows stay as they are, null text gives null and ``no json``."""
    rest = [c for c in df.columns if c not in (value, error)]
    out = T.StructType([*(df.schema[c] for c in rest), T.StructField(value, T.StringType()), T.StructField(error, T.StringType())])

    def one(x: str | None) -> tuple[str | None, str | None]:
        try:
            parsed = coerced(json.loads(x), schema) if x is not None else None
        except (ValueError, RecursionError):
            return None, "no json"
        if x is None:
            return None, "no json"
        broken = violation(parsed, schema)
        return (None, broken) if broken else (json.dumps(parsed, ensure_ascii=False, sort_keys=True), None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [one(x) for x in batch.column(len(rest)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array([a for a, _ in rows], pa.string()), pa.array([b for _, b in rows], pa.string())], names=out.names)

    return df.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text}`").alias("__text")).mapInArrow(run, out)


# Columns every table must have, types a schema may name, phrases that say nothing.
REQUIRED_METADATA = ("Title", "Authors", "Publication Year")
SCHEMA_TYPES = ("text", "number", "categorical", "boolean")
GENERIC_STARTS = ("extracted from the provided pdf evidence for", "the quoted sentence directly supports the proposed value", "the provided evidence directly supports the proposed value", "supported by the provided evidence")
GENERIC_PARTS = ("states or shows the relevant method, assay, result, or figure", "page-specific evidence because it states or shows", "relevant method, assay, result, or figure", "evidence specifically describes that field", "is recorded because the cited")


def missing_columns(columns: Sequence[str]) -> list[str]:
    """Required columns a table lacks."""
    return [c for c in REQUIRED_METADATA if c not in columns]


def schema_errors(column: str, description: str, field_type: str, allowed: str) -> Column:
    """What is wrong with a row of a schema, in order."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    typed = ~blank(field_type)
    return F.array_compact(F.array(
        F.when(blank(column), "missing column_name"), F.when(blank(description), "missing description"), F.when(typed & ~F.col(field_type).isin(*SCHEMA_TYPES), "invalid field_type"),
        F.when((F.size(F.coalesce(F.col(allowed), F.array().cast("array<string>"))) > 0) & ~F.coalesce(F.col(field_type) == "categorical", F.lit(False)), "allowed_values need categorical"),
    ))


def is_generic(text: str) -> Column:
    """A reason that would fit any value."""
    t = F.rtrim(F.lower(F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"(?U)\s+", " "))), F.lit("."))
    hit = [t.startswith(p) for p in GENERIC_STARTS] + [t.contains(p) for p in GENERIC_PARTS]
    out = hit[0]
    for x in hit[1:]:
        out = out | x
    return (t != "") & out


def inferred_type(gold: str, proposed: str, declared: str, allowed: str) -> Column:
    """The type two values are compared by: the declared one, else categorical with allowed values, numeric or boolean if both are, else text."""
    number = lambda c: F.expr(f"({v.number_bounds(c)[0]}) is not null")
    truth = lambda c: F.expr(f"({v.boolean_value(c)}) is not null")
    clear = lambda c: F.lower(F.trim(F.col(c))).isin(*v.BOOLEAN_TRUE, *v.BOOLEAN_FALSE)
    return (
        F.when(F.trim(F.coalesce(F.col(declared), F.lit(""))) != "", F.col(declared)).when(F.size(F.coalesce(F.col(allowed), F.array().cast("array<string>"))) > 0, "categorical").when(number(gold) & number(proposed), "numeric")
        .when(truth(gold) & truth(proposed) & (clear(gold) | clear(proposed)), "boolean").otherwise("text")
    )


def preflight(gold_columns: Sequence[str], schema_columns: Sequence[str], n_gold: int, n_table: int) -> list[str]:
    """Why a gold table cannot be used: join columns it lacks, columns no schema knows, another number of rows than the table."""
    errors = [f"missing join column: {c}" for c in ("row_id", "row_index") if c not in gold_columns]
    known = {"row_id", "row_index", "column_name", "gold_value", "cell_id", *schema_columns}
    if schema_columns and (unknown := sorted(c for c in gold_columns if c and c not in known and not c.endswith("__cell_id"))):
        errors.append(f"columns absent from schema: {', '.join(unknown)}")
    if n_gold and not n_table:
        errors.append("table has no rows")
    elif n_gold and n_table != n_gold:
        errors.append(f"table has {n_table} rows, gold {n_gold}")
    return errors


def covered_rows(gold: DataFrame, matches: DataFrame, index: str) -> DataFrame:
    """Gold cells of rows that a paper was matched to and that are not blocked."""
    usable = matches.where((F.col("outcome") == "matched") & ~F.coalesce("blocked", F.lit(False))).select(F.col("matched_row_index").cast("long").alias(index)).where(F.col(index).isNotNull()).distinct()
    return gold.join(usable, index, "left_semi")


def valid_region(x0: str, y0: str, x1: str, y1: str, page: str) -> Column:
    """A box of finite numbers with its corners in order, on a page that exists."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf"))
    return F.coalesce(finite(x0) & finite(y0) & finite(x1) & finite(y1) & (F.col(x0) < F.col(x1)) & (F.col(y0) < F.col(y1)) & (F.col(page) > 0), F.lit(False))


def package_errors(proposals: DataFrame, evidence: DataFrame, rows: DataFrame, columns: DataFrame, allowed: Mapping[str, Sequence[str]]) -> DataFrame:
    """Rules a package of proposals breaks: ``rule``, ``key``; one row per rule and record.

    Proposals of rows and columns that are not there, ids used twice with different contents, values of listed fields
    (``allowed``) that are none of them, evidence of unknown proposals, evidence on no page, values without any evidence.
    """
    p = proposals.distinct()
    ids = p.groupBy("proposal_id").agg(F.count("*").alias("n"))
    rule = lambda df, name, key: df.select(F.lit(name).alias("rule"), F.col(key).cast("string").alias("key"))
    parts = [
        rule(p.join(rows.select("row_id").distinct(), "row_id", "left_anti"), "unknown row", "proposal_id"), rule(p.join(columns.select("column_name").distinct(), "column_name", "left_anti"), "unknown column", "proposal_id"), rule(ids.where("n > 1"), "id used twice", "proposal_id"),
        *[rule(p.where(F.col(c).isNotNull() & ~F.col(c).isin(*values)), f"unknown {c}", "proposal_id") for c, values in allowed.items()],
        rule(evidence.distinct().join(p.select("proposal_id").distinct(), "proposal_id", "left_anti"), "evidence of unknown proposal", "evidence_id"), rule(evidence.where(~F.coalesce(F.col("page_number") > 0, F.lit(False))), "evidence on no page", "evidence_id"),
        rule(p.where("proposal_status = 'value_proposed'").join(evidence.select("proposal_id").distinct(), "proposal_id", "left_anti"), "value without evidence", "proposal_id"),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.distinct()
