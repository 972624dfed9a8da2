"""Reports as JSON: the contract between scans and deltas."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from duplet.operators import blocks as blocks_op
from duplet.operators import clones as clones_op
from duplet.operators import vocab as vocab_op

VERSION = 1
_UNIT = "struct<file: string, qualname: string, start_line: long, end_line: long, hash: string>"
_PLACE = "struct<file: string, start_line: long, end_line: long>"
SCHEMAS = {
    "clones": f"similarity double, a {_UNIT}, b {_UNIT}",
    "vocab": "a string, b string, overlap double, shared long, a_vocabulary long, b_vocabulary long, a_inbound_imports long, b_inbound_imports long, zero_inbound boolean, sample_shared array<string>",
    "blocks": f"a {_PLACE}, b {_PLACE}, tokens long, hash string",
}
_SIDE = {"file": str, "start_line": int, "end_line": int}
_FIELDS = {
    "clones": {"similarity": float, "a": {**_SIDE, "qualname": str, "hash": str}, "b": {**_SIDE, "qualname": str, "hash": str}},
    "vocab": {"a": str, "b": str, "overlap": float, "shared": int, "a_vocabulary": int, "b_vocabulary": int, "a_inbound_imports": int, "b_inbound_imports": int, "zero_inbound": bool, "sample_shared": list},
    "blocks": {"a": _SIDE, "b": _SIDE, "tokens": int, "hash": str},
}


class ReportError(ValueError):
    """A report can't be read, is malformed, or has another version."""


def to_rows(found: DataFrame, ordered) -> list[dict]:
    return [r.asDict(recursive=True) for r in ordered(found).collect()]


def build(scanned: dict) -> dict:
    """The report of a scan, its findings in report order. Collects: it is for people and tools that read JSON; the DataFrames stay for the rest."""
    return {
        "version": VERSION,
        "files_scanned": scanned["files_scanned"],
        "units_considered": scanned["units_considered"],
        "files_with_syntax_errors": sorted(set(scanned["files_with_syntax_errors"])),
        "clones": to_rows(scanned["clones"], clones_op.in_order),
        "vocab": to_rows(scanned["vocab"], vocab_op.in_order),
        "blocks": to_rows(scanned["blocks"], blocks_op.in_order),
    }


def finding_count(report: dict) -> int:
    return sum(len(report[k]) for k in SCHEMAS)


def dumps(report: dict) -> str:
    return json.dumps(report, indent=2, ensure_ascii=False)


def write(report: dict, path: str | Path) -> None:
    Path(path).write_text(dumps(report) + "\n", encoding="utf-8")


def _check(value, kind, where: str) -> None:
    if isinstance(kind, dict):
        if not isinstance(value, dict):
            raise ReportError(f"malformed: {where} is no object")
        for k, x in kind.items():
            if k not in value:
                raise ReportError(f"malformed: {where}.{k} is missing")
            _check(value[k], x, f"{where}.{k}")
    elif kind is float and isinstance(value, int) and not isinstance(value, bool):
        return
    elif not isinstance(value, kind) or (kind is int and (isinstance(value, bool) or value < 0)):
        raise ReportError(f"malformed: {where} is not of type {kind.__name__}")


def loads(text: str) -> dict:
    """A report, refused unless its version is ours and every field is there; fields beyond are left alone."""
    try:
        raw = json.loads(text)
    except json.JSONDecodeError as e:
        raise ReportError(f"malformed: {e}") from e
    _check(raw, {"version": int}, "report")
    if raw["version"] != VERSION:
        raise ReportError(f"version {raw['version']} is not supported, only {VERSION}")
    _check(raw, {"files_scanned": int, "units_considered": int, "files_with_syntax_errors": list, **{k: list for k in _FIELDS}}, "report")
    for name, kind in _FIELDS.items():
        for i, row in enumerate(raw[name]):
            _check(row, kind, f"{name}[{i}]")
    return raw


def read(path: str | Path) -> dict:
    try:
        return loads(Path(path).read_text(encoding="utf-8"))
    except OSError as e:
        raise ReportError(f"{path}: {e.strerror}") from e
    except UnicodeDecodeError as e:
        raise ReportError(f"malformed: {path} is not UTF-8") from e


def frames(spark: SparkSession, report: dict) -> dict[str, DataFrame]:
    """The findings of a report as DataFrames."""

    def row(kind: str, r: dict) -> dict:
        out = {k: r[k] for k in _FIELDS[kind]}
        for k in ("similarity", "overlap"):
            if k in out:
                out[k] = float(out[k])
        return out

    return {k: spark.createDataFrame([row(k, r) for r in report[k]], s) for k, s in SCHEMAS.items()}


def build_empty() -> dict:
    """The report of a tree without files."""
    return {"version": VERSION, "files_scanned": 0, "units_considered": 0, "files_with_syntax_errors": [], "clones": [], "vocab": [], "blocks": []}
