"""Incremental runs: fingerprints of schemas, what changed, merging of profiles, stored state."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import math
import os
from dataclasses import dataclass
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col
from ..sources.readers import TableInfo


def column_hash(columns: list[tuple[str, str]]) -> str:
    """16 hex digits of SHA-256 over the sorted name:canonical_type, joined by |."""
    return hashlib.sha256("|".join(sorted(f"{n}:{t}" for n, t in columns)).encode()).hexdigest()[:16]


@dataclass
class Change:
    changed: bool
    reason: str
    row_count: int | None
    column_hash: str
    watermark: str | None = None


def watermark(df: DataFrame, column: str) -> str | None:
    """Largest value as a string; Parquet footers answer where aggregate pushdown is on."""
    return df.agg(F.max(col(column)).cast("string").alias("w")).first()["w"]


def check_delta(df: DataFrame, info: TableInfo, prior: dict[str, Any] | None, watermark_column: str | None = None) -> Change:
    """new_table, schema_changed, watermark_advanced (it differs), row_count_changed or unchanged, whichever comes first."""
    now = column_hash([(c.name, c.canonical_type) for c in info.columns])
    mark, moved = None, False
    if watermark_column and watermark_column in df.columns:
        old = (prior or {}).get("watermark_value")
        # compared in the column's own type: as strings, 10 would come before 9
        last, kind = F.max(col(watermark_column)), df.schema[watermark_column].dataType
        mark, moved = df.agg(last.cast("string"), F.coalesce(last != F.lit(old).try_cast(kind), F.lit(old is not None) & last.isNotNull())).first()
    if prior is None:
        return Change(True, "new_table", None, now, mark)
    if prior["column_hash"] != now:
        return Change(True, "schema_changed", None, now, mark)
    if moved:
        return Change(True, "watermark_advanced", None, now, mark)
    count = df.count()
    return Change(count != prior["row_count"], "row_count_changed" if count != prior["row_count"] else "unchanged", count, now, mark)


#: How the fields of column profiles merge; all others are the later one's.
ADDED = ("null_count", "sum", "zero_count", "negative_count", "infinite_count", "empty_count", "whitespace_count", "leading_trailing_whitespace_count", "true_count", "false_count", "non_null")
LEAST, MOST, JOINED = ("min", "min_length"), ("max", "max_length", "approx_distinct", "distinct_values"), ("patterns", "anomalies")


def merge_columns(a: dict[str, Any], b: dict[str, Any], na: int, nb: int, exact: bool = False) -> dict[str, Any]:
    """Profile of a column over both parts. ``exact`` weighs by values and counts the variance as a sample's (n - 1)."""
    out, n = dict(b), na + nb
    for keys, how in ((ADDED, lambda x, y: x + y), (LEAST, min), (MOST, max)):
        for k in keys:
            if a.get(k) is not None or b.get(k) is not None:
                out[k] = how(a[k], b[k]) if a.get(k) is not None and b.get(k) is not None else a.get(k) if b.get(k) is None else b[k]
    for k in JOINED:
        out[k] = list(dict.fromkeys([*a.get(k, ()), *b.get(k, ())]))
    out["pattern_scores"] = {**a.get("pattern_scores", {}), **b.get("pattern_scores", {})}
    out["null_rate"] = out.get("null_count", 0) / max(1, n)
    if a.get("mean") is not None and b.get("mean") is not None and n:
        wa, wb = (na - a.get("null_count", 0), nb - b.get("null_count", 0)) if exact else (na, nb)
        less = 1 if exact else 0
        d, w = b["mean"] - a["mean"], wa + wb
        m2 = (a.get("variance") or 0.0) * (wa - less) + (b.get("variance") or 0.0) * (wb - less) + d * d * wa * wb / w
        out["mean"] = (wa * a["mean"] + wb * b["mean"]) / w
        out["variance"] = m2 / (w - less) if w > less else None
        out["stddev"] = math.sqrt(out["variance"]) if out["variance"] is not None else None
    elif b.get("mean") is None and a.get("mean") is not None and exact:
        out |= {k: a.get(k) for k in ("mean", "variance", "stddev")}
    return out


def merge_profiles(prior: dict[str, Any], delta: dict[str, Any], exact: bool = False) -> dict[str, Any]:
    """Profile of an append-only table from that of its earlier rows and of the new ones; dropped columns go."""
    na, nb = prior["total_row_count"], delta["total_row_count"]
    old = {c["name"]: c for c in prior["columns"]}
    extra = prior.get("duplicate_row_count", 0) + delta.get("duplicate_row_count", 0)
    return delta | {
        "total_row_count": na + nb,
        "sampled_row_count": prior.get("sampled_row_count", na) + delta.get("sampled_row_count", nb),
        "columns": [merge_columns(old[c["name"]], c, na, nb, exact) if c["name"] in old else c for c in delta["columns"]],
        "duplicate_row_count": extra,
        "duplicate_rate": extra / max(1, na + nb),
        "comment": delta.get("comment") or prior.get("comment"),
        "constraints": delta.get("constraints") or prior.get("constraints"),
        "profiled_at": max(prior.get("profiled_at") or "", delta.get("profiled_at") or ""),
        "duration_seconds": (prior.get("duration_seconds") or 0) + (delta.get("duration_seconds") or 0),
    }


MONOID = ("rows", "non_null", "total", "squares", "least", "largest")


def partials(df: DataFrame, columns: list[str], *keys: str) -> DataFrame:
    """Mergeable statistics: the keys, column_name, rows, non_null, mean, m2, least, largest and a distinct sketch."""
    parts = []
    for c in columns:
        x = col(c).cast("double")
        n = F.count(x)
        parts.append(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), n.alias("non_null"), F.avg(x).alias("mean"), (F.var_pop(x) * n).alias("m2"), F.min(x).alias("least"), F.max(x).alias("largest"), F.hll_sketch_agg(col(c).cast("string")).alias("sketch")).select(*keys, F.lit(c).alias("column_name"), "rows", "non_null", "mean", "m2", "least", "largest", "sketch"))
    from ..functions.columns import union

    return union(parts)


def merge_partials(parts: DataFrame, *keys: str) -> DataFrame:
    """One row per keys and column_name over all partial rows.

    The squared deviations are the parts' own plus those of their means from the common mean, which is found first: sums of
    squares would cancel where values are far from 0.
    """
    by = [*keys, "column_name"]
    base = parts.groupBy(*by).agg(F.min("mean").alias("base"))
    n = F.sum("non_null")

    def with_(rows: DataFrame, more: DataFrame) -> DataFrame:
        more = more.withColumnsRenamed({c: f"_{c}" for c in by})
        on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
        return rows.join(more, on).drop(*[f"_{c}" for c in by])

    near = with_(parts, base)
    common = near.groupBy(*by).agg((F.first("base") + F.try_divide(F.sum((F.col("mean") - F.col("base")) * F.col("non_null")), n)).alias("common"))
    near = with_(parts, common)
    m2 = F.sum(F.col("m2") + F.col("non_null") * F.pow(F.col("mean") - F.col("common"), F.lit(2)))
    sums = [F.sum("rows").alias("rows"), n.alias("non_null"), F.first("common").alias("mean"), m2.alias("m2"), F.min("least").alias("least"), F.max("largest").alias("largest"), F.hll_union_agg("sketch").alias("sketch")]
    return near.groupBy(*by).agg(*sums)


class StateStore:
    """Snapshots and checkpoints of runs as small JSON files below a folder, one a table, written in one step."""

    def __init__(self, root: str):
        self.root = Path(root)

    def _path(self, run_id: str, kind: str, table: str) -> Path:
        return self.root / run_id / kind / f"{hashlib.sha256(table.encode()).hexdigest()[:24]}.json"

    def _write(self, path: Path, value: dict[str, Any]) -> None:
        path.parent.mkdir(parents=True, exist_ok=True)
        part = path.with_suffix(f".{os.getpid()}.part")
        part.write_text(json.dumps(value, default=str))
        part.replace(path)

    def put(self, run_id: str, table: str, profile: dict[str, Any], change: Change, database: str | None = None, schema: str | None = None) -> None:
        at = dt.datetime.now(dt.timezone.utc).isoformat()
        self._write(self._path(run_id, "profiles", table), {"run_id": run_id, "table_name": table, "profile": profile, "row_count": profile["total_row_count"], "column_hash": change.column_hash, "watermark_value": change.watermark, "database": database, "schema_name": schema, "stored_at": at})

    def get(self, run_id: str, table: str) -> dict[str, Any] | None:
        path = self._path(run_id, "profiles", table)
        return json.loads(path.read_text()) if path.exists() else None

    def latest_run_id(self, database: str | None = None, schema: str | None = None) -> str | None:
        found = [json.loads(p.read_text()) for p in self.root.glob("*/profiles/*.json")]
        found = [x for x in found if x["database"] == database and x["schema_name"] == schema]
        return max(found, key=lambda x: x["stored_at"])["run_id"] if found else None

    def mark(self, run_id: str, table: str, status: str, error: str | None = None) -> None:
        if status not in ("pending", "in_progress", "done", "error", "skipped"):
            raise ValueError(f"no status {status!r}")
        path, now = self._path(run_id, "checkpoints", table), dt.datetime.now(dt.timezone.utc).isoformat()
        old = json.loads(path.read_text()) if path.exists() else {}
        over = status in ("done", "error", "skipped")
        self._write(path, {"run_id": run_id, "table_name": table, "status": status, "started_at": old.get("started_at", now), "completed_at": now if over else None, "error_message": error})

    def finished(self, run_id: str) -> set[str]:
        found = [json.loads(p.read_text()) for p in (self.root / run_id / "checkpoints").glob("*.json")]
        return {x["table_name"] for x in found if x["status"] in ("done", "skipped")}
