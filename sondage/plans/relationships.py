"""Relationships between tables: declared, by name, composite and inferred, with overlaps of values."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col

#: Endings that make a column a key, and of the tables that it may refer to (fixed values).
KEY_ENDINGS = ("_sk", "_id", "_key")
TABLE_FORMS = ("{}", "{}_dim", "{}s")
SEMANTIC, INFERRED, COMPOSITE = 0.6, 0.5, 0.5


def overlap(left: DataFrame, left_columns: list[str], right: DataFrame, right_columns: list[str], limit: int | None = None) -> DataFrame:
    """overlap_count of distinct value tuples in both, their shares of either side, and a confidence.

    Nulls do not count. ``limit`` looks at so many rows of each side; without it all are compared, by a semi-join of the
    distinct tuples. The confidence is count / (limit // 10), limit 10000 by default, raised to 0.5 to 1 when over 0.1.
    """

    def side(df: DataFrame, columns: list[str]) -> DataFrame:
        rows = df.select(*[col(c).alias(f"k{i}") for i, c in enumerate(columns)]).dropna()
        return (rows.limit(limit) if limit else rows).distinct()

    a, b = side(left, left_columns), side(right, right_columns)
    keys = [f"k{i}" for i in range(len(left_columns))]
    flags = a.withColumn("l", F.lit(1)).unionByName(b.withColumn("l", F.lit(2))).groupBy(*keys).agg(F.sum("l").alias("s"))
    counts = flags.agg(F.count_if(F.col("s") == 3).alias("overlap_count"), F.count_if(F.col("s") != 2).alias("left_distinct"), F.count_if(F.col("s") != 1).alias("right_distinct"))
    raw = F.least(F.lit(1.0), F.col("overlap_count") / F.lit((limit or 10_000) // 10))
    share = lambda n: F.coalesce(F.round(F.try_divide("overlap_count", n), 6), F.lit(0.0))
    return counts.select("*", share("left_distinct").alias("left_contained"), share("right_distinct").alias("right_contained"), F.when(raw > 0.1, F.least(F.lit(1.0), 0.5 + 0.5 * raw)).otherwise(raw).alias("confidence"))


def entity_of(column: str) -> tuple[str, str] | None:
    """What a key column names, without its first segment if there are more, and the ending; None for other columns."""
    ending = next((e for e in KEY_ENDINGS if column.lower().endswith(e)), None)
    stem = column.lower()[: -len(ending)] if ending else ""
    if not stem:
        return None
    return (stem.split("_", 1)[1] if "_" in stem else stem), ending


def discover_relationships(profiles: list[dict[str, Any]], read: Callable[[str], DataFrame] | None = None, limit: int | None = 10_000, include_inferred: bool = True) -> list[dict[str, Any]]:
    """Relationships of profiled tables, surest kinds first; a pair of columns is told once. ``read`` allows overlaps."""
    tables = {p["name"]: p for p in profiles if not p.get("error")}
    columns = {t: {c["name"]: c for c in p["columns"]} for t, p in tables.items()}
    out: list[dict[str, Any]] = []
    seen: set[frozenset] = set()

    def unique(c: dict[str, Any]) -> bool:
        return "all_unique" in c.get("anomalies", ())

    def add(kind: str, st: str, sc: list[str], tt: str, tc: list[str], confidence: float, count: int | None = None) -> None:
        key = frozenset([(st, tuple(sc)), (tt, tuple(tc))])
        if key not in seen:
            seen.add(key)
            out.append({"source_table": st, "source_columns": sc, "target_table": tt, "target_columns": tc, "relationship_type": kind, "confidence": confidence, "overlap_count": count})

    def measured(st: str, sc: list[str], tt: str, tc: list[str], least: float) -> tuple[float, int | None]:
        if read is None:
            return least, None
        r = overlap(read(st), sc, read(tt), tc, limit).first()
        return (r["confidence"] if r["overlap_count"] else least), r["overlap_count"]

    for t, p in tables.items():
        for fk in (p.get("constraints") or {}).get("foreign_keys", []):
            add("declared_fk", t, list(fk["constrained_columns"]), fk["referred_table"], list(fk["referred_columns"]), 1.0)
    if not include_inferred:
        return out
    for t in sorted(tables):
        for name, c in columns[t].items():
            if (hint := entity_of(name)) is None:
                continue
            entity, ending = hint
            for target in (x for x in sorted(tables) if x != t and x.lower() in [f.format(entity) for f in TABLE_FORMS]):
                named = [entity + e for e in KEY_ENDINGS] + [name.lower()]
                fits = [x for x in columns[target].values() if (x["name"].lower() in named or x["name"].lower().endswith(entity + ending)) and x["canonical_type"] == c["canonical_type"] and unique(x)]
                if fits and frozenset([(t, (name,)), (target, (fits[0]["name"],))]) not in seen:
                    add("semantic_fk", t, [name], target, [fits[0]["name"]], *measured(t, [name], target, [fits[0]["name"]], SEMANTIC))
    for t, p in sorted(tables.items()):
        keys = list((p.get("constraints") or {}).get("primary_key", []))
        for other in sorted(tables) if len(keys) > 1 else ():
            if other != t and all(k in columns[other] and columns[other][k]["canonical_type"] == columns[t][k]["canonical_type"] for k in keys):
                add("inferred_composite", other, keys, t, keys, *measured(other, keys, t, keys, COMPOSITE))
    names = sorted(tables)
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            for name in sorted(set(columns[a]) & set(columns[b])):
                x, y = columns[a][name], columns[b][name]
                if x["canonical_type"] == y["canonical_type"] and (unique(x) or unique(y)) and frozenset([(a, (name,)), (b, (name,))]) not in seen:
                    st, tt = (a, b) if unique(y) else (b, a)
                    add("inferred", st, [name], tt, [name], *measured(st, [name], tt, [name], INFERRED))
    return out


def suggest_foreign_keys(relationships: list[dict[str, Any]]) -> list[dict[str, Any]]:
    q = lambda s: '"' + s.replace('"', '""') + '"'
    listed = lambda xs: ", ".join(map(q, xs))
    return [
        {
            "table": r["source_table"], "column": ", ".join(r["source_columns"]), "constraint_type": "FOREIGN KEY", "confidence": r["confidence"], "evidence": r["relationship_type"],
            "expression": f"ALTER TABLE {q(r['source_table'])} ADD CONSTRAINT {q('fk_' + r['source_table'] + '_' + '_'.join(r['source_columns']))} FOREIGN KEY ({listed(r['source_columns'])}) REFERENCES {q(r['target_table'])} ({listed(r['target_columns'])})",
        }
        for r in relationships
    ]
