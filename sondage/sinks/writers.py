"""Outputs of a run: NDJSON, YAML, Parquet, CSV, JSON-LD, GraphML, catalog JSON and an HTML page.

A profile is a few rows a table, so text formats are written on the driver; Parquet and CSV by Spark.
"""

from __future__ import annotations

import html
import json
import xml.etree.ElementTree as ET
from collections.abc import Callable
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import graph

Profiles = list[dict[str, Any]]
Writer = Callable[[str, Profiles, list[dict], dict[str, Any], SparkSession | None], None]
FORMATS: dict[str, Writer] = {}


def _format(name: str) -> Callable[[Writer], Writer]:
    def add(f: Writer) -> Writer:
        FORMATS[name] = f
        return f

    return add


def write(kind: str, path: str, profiles: Profiles, relationships: list[dict], header: dict[str, Any], spark: SparkSession | None = None) -> None:
    if kind not in FORMATS:
        raise ValueError(f"no output format {kind!r}")
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    FORMATS[kind](path, profiles, relationships, header, spark)


def _clean(x: Any) -> Any:
    """Without empty fields; JSON has no NaN or infinities."""
    if isinstance(x, dict):
        return {k: _clean(v) for k, v in x.items() if v is not None}
    if isinstance(x, (list, tuple)):
        return [_clean(v) for v in x]
    return str(x) if isinstance(x, float) and (x != x or abs(x) == float("inf")) else x


def _json(x: Any, **more: Any) -> str:
    return json.dumps(_clean(x), default=str, **more)


@_format("json")
def ndjson(path: str, profiles: Profiles, relationships: list[dict], header: dict[str, Any], spark: SparkSession | None = None) -> None:
    """A header, a line for each table, and a last line with the relationships."""
    last = {"_relationships": True, "count": len(relationships), "relationships": relationships}
    Path(path).write_text("".join(_json(x) + "\n" for x in (header, *profiles, last)))


def _scalar(x: Any) -> str:
    if x is None:
        return "null"
    if isinstance(x, bool):
        return "true" if x else "false"
    return str(x) if isinstance(x, (int, float)) else json.dumps(str(x), ensure_ascii=False)


def _yaml(x: Any, pad: str = "") -> list[str]:
    lines: list[str] = []
    for k, v in x.items() if isinstance(x, dict) else (("-", v) for v in x):
        name = f"{pad}-" if k == "-" and not isinstance(x, dict) else f"{pad}{_scalar(k) if not str(k).replace('_', '').isalnum() else k}:"
        if isinstance(v, (dict, list)) and v:
            lines += [name, *_yaml(v, pad + "  ")]
        else:
            lines.append(f"{name} {'{}' if v == {} else '[]' if v == [] else _scalar(v)}")
    return lines


@_format("yaml")
def yaml(path: str, profiles: Profiles, relationships: list[dict], header: dict[str, Any], spark: SparkSession | None = None) -> None:
    """One document each for the header, every table without an error, and the relationships."""
    docs = [header, *(p for p in profiles if not p.get("error")), {"_relationships": True, "count": len(relationships), "relationships": relationships}]
    Path(path).write_text("".join("\n".join(["---", *_yaml(_clean(d))]) + "\n" for d in docs))


NESTED = ("histogram", "cdf", "kde", "qq_plot", "length_histogram", "box_plot", "benford_digits", "top_values", "bottom_values", "patterns", "pattern_scores", "anomalies")


def column_rows(profiles: Profiles, spark: SparkSession) -> DataFrame:
    """One row per column with the table's fields as table_*; min and max as strings, nested fields as JSON."""
    rows = []
    for p in (p for p in profiles if not p.get("error")):
        own = {f"table_{k}": v for k, v in p.items() if not isinstance(v, (list, dict))}
        for c in p["columns"]:
            rows.append(own | {k: _json(v) if k in NESTED and v is not None else str(v) if k in ("min", "max") and v is not None else v for k, v in c.items()})
    names = sorted({k for r in rows for k in r})
    kind = lambda k: next((("boolean" if isinstance(r[k], bool) else "double" if isinstance(r[k], (int, float)) else "string") for r in rows if r.get(k) is not None), "string")
    kinds = {k: kind(k) for k in names}
    cast = {"double": float, "boolean": bool, "string": str}
    data = [tuple(None if r.get(k) is None else cast[kinds[k]](r[k]) for k in names) for r in rows]
    return spark.createDataFrame(data, ", ".join(f"`{k}` {kinds[k]}" for k in names) or "name string")


@_format("parquet")
def parquet(path: str, profiles: Profiles, relationships: list[dict], header: dict[str, Any], spark: SparkSession | None = None) -> None:
    column_rows(profiles, spark).coalesce(1).write.mode("overwrite").parquet(path)


@_format("csv")
def csv(path: str, profiles: Profiles, relationships: list[dict], header: dict[str, Any], spark: SparkSession | None = None) -> None:
    flat = column_rows(profiles, spark)
    flat.select(*[F.col(f"`{c}`") for c in flat.columns if c not in NESTED]).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


#: Terms of the linked-data output (fixed values).
CONTEXT = {
    "schema": "http://schema.org/",
    "profiler": "urn:profiler:ontology:",
    "name": "schema:name",
    "Database": "profiler:Database",
    "Schema": "profiler:Schema",
    "Table": "profiler:Table",
    "Column": "profiler:Column",
    "HAS_SCHEMA": "profiler:hasSchema",
    "HAS_TABLE": "profiler:hasTable",
    "HAS_COLUMN": "profiler:hasColumn",
    "FK_DECLARED": "profiler:fkDeclared",
    "FK_SEMANTIC": "profiler:fkSemantic",
    "FK_INFERRED": "profiler:fkInferred",
    "FK_COMPOSITE": "profiler:fkComposite",
    "FUNCTIONAL_DEP": "profiler:functionalDep",
    "SIMILAR_TO": "profiler:similarTo",
}


def _graph(profiles: Profiles, relationships: list[dict], header: dict[str, Any]) -> tuple[list[dict], list[dict]]:
    return graph.build(profiles, relationships, header.get("database"), header.get("schema"), header.get("engine"))


@_format("jsonld")
def jsonld(path: str, profiles: Profiles, relationships: list[dict], header: dict[str, Any], spark: SparkSession | None = None) -> None:
    nodes, edges = _graph(profiles, relationships, header)
    items = [{"@id": x["id"], "@type": x["label"]} | x["properties"] for x in nodes]
    items += [{"@id": x["id"], "@type": x["label"], "source": x["source"], "target": x["target"]} | x["properties"] for x in edges]
    Path(path).write_text(_json({"@context": CONTEXT, "@graph": items}, indent=2))


@_format("graphml")
def graphml(path: str, profiles: Profiles, relationships: list[dict], header: dict[str, Any], spark: SparkSession | None = None) -> None:
    """Typed keys of nodes and edges; lists as JSON strings."""
    nodes, edges = _graph(profiles, relationships, header)
    root = ET.Element("graphml", xmlns="http://graphml.graphdrawing.org/xmlns")
    kind = lambda v: "boolean" if isinstance(v, bool) else "long" if isinstance(v, int) else "double" if isinstance(v, float) else "string"
    for what, items, short in (("node", nodes, "n"), ("edge", edges, "d")):
        keys = {"label": "string"}
        for x in items:
            keys |= {k: kind(v) for k, v in x["properties"].items() if v is not None}
        for k, t in sorted(keys.items()):
            ET.SubElement(root, "key", {"id": f"{short}_{k}", "for": what, "attr.name": k, "attr.type": t})
    body = ET.SubElement(root, "graph", id="G", edgedefault="directed")
    for what, items, short in (("node", nodes, "n"), ("edge", edges, "d")):
        for x in items:
            at = ET.SubElement(body, what, {k: x[k] for k in ("id", "source", "target") if k in x})
            for k, v in ({"label": x["label"]} | x["properties"]).items():
                if v is not None:
                    ET.SubElement(at, "data", key=f"{short}_{k}").text = _json(v) if isinstance(v, (list, dict)) else str(v).lower() if isinstance(v, bool) else str(v)
    ET.ElementTree(root).write(path, encoding="utf-8", xml_declaration=True)


def _catalog_column(c: dict[str, Any], n: int) -> dict[str, Any]:
    stats = {"valuesCount": n - c.get("null_count", 0), "nullCount": c.get("null_count", 0), "nullProportion": c.get("null_rate", 0.0)} if n else {}
    stats |= {"uniqueCount": c.get("approx_distinct", 0)}
    if n and c.get("approx_distinct"):
        stats["uniqueProportion"] = c["approx_distinct"] / n
    stats |= {k: str(c[k]) for k in ("min", "max") if c.get(k) is not None}
    stats |= {to: c[k] for k, to in (("mean", "mean"), ("stddev", "stddev"), ("median", "median"), ("max_length", "maxLength")) if c.get(k) is not None}
    if c.get("patterns"):
        stats["customMetrics"] = [{"name": f"pattern_{p}", "value": c["pattern_scores"].get(p, 0)} for p in c["patterns"]]
    return {"name": c["name"], "dataType": c["canonical_type"].upper(), "dataTypeDisplay": c["engine_type"], "profile": stats}


def _catalog_table(p: dict[str, Any]) -> dict[str, Any]:
    n = p.get("total_row_count", 0)
    told = {"timestamp": p.get("profiled_at"), "rowCount": n, "columnCount": len(p["columns"]), "sampleCount": p.get("sampled_row_count", n)}
    if p.get("duplicate_row_count"):
        told |= {"duplicateCount": p["duplicate_row_count"], "duplicateProportion": p["duplicate_rate"]}
    out = {"name": p["name"], "description": p.get("comment") or "", "tableType": "Regular", "columns": [_catalog_column(c, n) for c in p["columns"]], "tableProfile": told}
    own, listed = p.get("constraints") or {}, []
    if own.get("primary_key"):
        listed.append({"constraintType": "PRIMARY_KEY", "columns": own["primary_key"]})
    for f in own.get("foreign_keys", []):
        listed.append({"constraintType": "FOREIGN_KEY", "columns": f["constrained_columns"], "referredColumns": [f"{f['referred_table']}.{c}" for c in f["referred_columns"]]})
    listed += [{"constraintType": "UNIQUE", "columns": u["columns"]} for u in own.get("unique_constraints", [])]
    return out | ({"tableConstraints": listed} if listed else {})


@_format("openmetadata")
def openmetadata(path: str, profiles: Profiles, relationships: list[dict], header: dict[str, Any], spark: SparkSession | None = None) -> None:
    document = {"openMetadataExport": True, "version": "1.0", "runId": header.get("run_id", ""), "source": {k: header.get(k) or "" for k in ("engine", "database", "schema")}, "tables": [_catalog_table(p) for p in profiles if not p.get("error")]}
    Path(path).write_text(_json(document | ({"relationships": relationships} if relationships else {}), indent=2))


def _bars(values: list[tuple[str, float]]) -> str:
    most = max((v for _, v in values), default=0) or 1
    return "".join(f'<div class="bar"><span style="width:{100 * v / most:.1f}%"></span>{html.escape(k)} <b>{v:g}</b></div>' for k, v in values)


@_format("html")
def page(path: str, profiles: Profiles, relationships: list[dict], header: dict[str, Any], spark: SparkSession | None = None) -> None:
    """A page without scripts: overview, tables, quality, columns, missing values, correlations, patterns, relationships."""
    e = lambda x: html.escape("" if x is None else str(x))
    row = lambda *xs, tag="td": "<tr>" + "".join(f"<{tag}>{x}</{tag}>" for x in xs) + "</tr>"
    good = [p for p in profiles if not p.get("error")]
    parts = [f"<h1>Data profile {e(header.get('run_id'))}</h1>", f"<p>{len(good)} tables, {sum(len(p['columns']) for p in good)} columns, {sum(p.get('total_row_count', 0) for p in good)} rows</p>", '<h2 id="tables">Tables</h2><table>', row("table", "rows", "columns", "duplicates", "quality", tag="th")]
    parts += [row(e(p["name"]), p.get("total_row_count", 0), len(p["columns"]), p.get("duplicate_row_count", 0), p.get("quality_score")) for p in good] + ["</table>", '<h2 id="quality">Quality</h2>', _bars([(p["name"], p.get("quality_score") or 0) for p in good]), '<h2 id="missing">Missing values</h2>', _bars([(f"{p['name']}.{c['name']}", round(c["null_rate"], 4)) for p in good for c in p["columns"] if c["null_rate"]])]
    for p in good:
        parts += [f'<h2 id="{e(p["name"])}">{e(p["name"])}</h2><table>', row("column", "type", "nulls", "distinct", "min", "max", "mean", "patterns", "anomalies", tag="th")]
        parts += [row(e(c["name"]), e(c["canonical_type"]), f"{c['null_rate']:.2%}", c.get("approx_distinct", ""), e(c.get("min")), e(c.get("max")), e(c.get("mean")), e(", ".join(c["patterns"])), e(", ".join(c["anomalies"]))) for c in p["columns"]]
        parts += ["</table>"] + [f"<h3>{e(c['name'])}</h3>" + _bars([(f"{b['bin_start']} to {b['bin_end']}", b["count"]) for b in c["histogram"]]) for c in p["columns"] if c.get("histogram")]
        strong = [r for r in p.get("correlations") or [] if abs(r.get("pearson") or r.get("cramers_v") or 0) > 0.5]
        if strong:
            parts += ["<h3>Correlations</h3><table>", *[row(e(r["col1"]), e(r["col2"]), e(r.get("pearson", r.get("cramers_v")))) for r in strong], "</table>"]
    if relationships:
        parts += ['<h2 id="relationships">Relationships</h2><table>', *[row(e(f"{r['source_table']}({', '.join(r['source_columns'])})"), e(f"{r['target_table']}({', '.join(r['target_columns'])})"), e(r["relationship_type"]), e(r["confidence"])) for r in relationships], "</table>"]
    failed = [p for p in profiles if p.get("error")]
    if failed:
        parts += ["<h2>Errors</h2><ul>", *[f"<li>{e(p['name'])}: {e(p['error'])}</li>" for p in failed], "</ul>"]
    style = "body{font:14px sans-serif;margin:2em}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:2px 6px}.bar{position:relative;max-width:40em;padding:1px 4px}.bar span{position:absolute;left:0;top:0;bottom:0;background:#cde;z-index:-1}"
    policy = "default-src 'none'; style-src 'unsafe-inline'"
    Path(path).write_text(f'<!doctype html><html><head><meta charset="utf-8"><meta http-equiv="Content-Security-Policy" content="{policy}"><title>Data profile</title><style>{style}</style></head><body>{"".join(parts)}</body></html>')
