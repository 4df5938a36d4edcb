"""The property graph of a run: databases, schemas, tables and columns, and how they relate."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Labels of relationship edges (fixed values).
EDGE_LABELS = {"declared_fk": "FK_DECLARED", "semantic_fk": "FK_SEMANTIC", "inferred": "FK_INFERRED", "inferred_composite": "FK_COMPOSITE"}
URN = "urn:profiler"
SIMILAR = 0.7


def urn(*parts: str | None) -> str:
    return ":".join([URN, *((p or "_").lower().replace(" ", "_") for p in parts)])


def urn_column(*parts: Column) -> Column:
    return F.concat_ws(":", F.lit(URN), *[F.replace(F.lower(F.coalesce(p, F.lit("_"))), F.lit(" "), F.lit("_")) for p in parts])


def build(profiles: list[dict[str, Any]], relationships: list[dict[str, Any]], database: str | None = None, schema: str | None = None, engine: str | None = None) -> tuple[list[dict], list[dict]]:
    """Nodes (id, label, properties) and edges (id, source, target, label, properties). Failed tables are left out."""
    database, schema = database or "default", schema or "default"
    at = lambda *p: urn(database, schema, *p)
    nodes = {
        urn(database): {"label": "Database", "properties": {"name": database, "engine": engine or ""}},
        at(): {"label": "Schema", "properties": {"name": schema, "database": database}},
    }
    edges: list[dict] = []

    def link(source: str, target: str, label: str, **properties: Any) -> None:
        edges.append({"id": f"e{len(edges) + 1}", "source": source, "target": target, "label": label, "properties": properties})

    link(urn(database), at(), "HAS_SCHEMA")
    for p in (p for p in profiles if not p.get("error")):
        t = p["name"]
        nodes[at(t)] = {"label": "Table", "properties": {"name": t, "schema": schema, "row_count": p.get("total_row_count", 0), "quality_score": p.get("quality_score"), "profiled_at": p.get("profiled_at")}}
        link(at(), at(t), "HAS_TABLE")
        for c in p["columns"]:
            kept = {k: c.get(k) for k in ("name", "canonical_type", "null_rate", "approx_distinct", "mean", "min", "max", "patterns", "anomalies")}
            nodes[at(t, c["name"])] = {"label": "Column", "properties": kept | {"table": t}}
            link(at(t), at(t, c["name"]), "HAS_COLUMN")
        for d in p.get("functional_dependencies") or []:
            if at(t, d["from"]) in nodes and at(t, d["to"]) in nodes:
                link(at(t, d["from"]), at(t, d["to"]), "FUNCTIONAL_DEP")
        for r in p.get("correlations") or []:
            value = next((r[k] for k in ("value", "correlation", "pearson") if r.get(k) is not None), 0)
            if abs(value) > SIMILAR and at(t, r["col1"]) in nodes and at(t, r["col2"]) in nodes:
                link(at(t, r["col1"]), at(t, r["col2"]), "SIMILAR_TO", correlation=value)
    for r in relationships:
        label = EDGE_LABELS.get(r["relationship_type"], "FK_INFERRED")
        if r["relationship_type"] == "inferred_composite":
            link(at(r["source_table"]), at(r["target_table"]), label, columns=r["source_columns"], confidence=r["confidence"])
        else:
            for a, b in zip(r["source_columns"], r["target_columns"]):
                link(at(r["source_table"], a), at(r["target_table"], b), label, confidence=r["confidence"])
    return [{"id": k} | v for k, v in nodes.items()], edges


def frames(spark: SparkSession, nodes: list[dict], edges: list[dict]) -> tuple[DataFrame, DataFrame]:
    """The same as DataFrames, properties as JSON."""
    text = lambda x: json.dumps(x, default=str)
    n = spark.createDataFrame([(x["id"], x["label"], text(x["properties"])) for x in nodes], "id string, label string, properties string")
    e = spark.createDataFrame([(x["id"], x["source"], x["target"], x["label"], text(x["properties"])) for x in edges], "id string, source string, target string, label string, properties string")
    return n, e


def schema_nodes(table_columns: DataFrame, database: str, schema: str) -> DataFrame:
    """id and label of all nodes for rows (table_name, column_name): the graph's frame without profiles."""
    d, s, t, c = F.lit(database), F.lit(schema), F.col("table_name"), F.col("column_name")
    one = table_columns.limit(1)
    parts = [one.select(urn_column(d).alias("id"), F.lit("Database").alias("label")), one.select(urn_column(d, s).alias("id"), F.lit("Schema").alias("label"))]
    parts += [table_columns.select(urn_column(d, s, t).alias("id"), F.lit("Table").alias("label")).distinct(), table_columns.select(urn_column(d, s, t, c).alias("id"), F.lit("Column").alias("label"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def schema_edges(table_columns: DataFrame, database: str, schema: str) -> DataFrame:
    d, s, t, c = F.lit(database), F.lit(schema), F.col("table_name"), F.col("column_name")
    e = lambda df, a, b, label: df.select(a.alias("source"), b.alias("target"), F.lit(label).alias("label"))
    top = e(table_columns.limit(1), urn_column(d), urn_column(d, s), "HAS_SCHEMA")
    return top.unionByName(e(table_columns, urn_column(d, s), urn_column(d, s, t), "HAS_TABLE").distinct()).unionByName(e(table_columns, urn_column(d, s, t), urn_column(d, s, t, c), "HAS_COLUMN"))
