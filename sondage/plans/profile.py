"""Profiles of tables: which operators run on which columns, and how their small results are put together.

Data stay in Spark; what reaches the driver is one row per column, pair or bin.
"""

from __future__ import annotations

import datetime as dt
import threading
import time
import uuid
from collections import defaultdict
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..operators import anomaly, assoc, core, dist, freq, patterns, rows
from ..sources.readers import Source, TableInfo, discover, sample
from ..types import DATES, KEYED, NUMERIC
from . import incremental, relationships

Profile = dict[str, Any]
#: Rows whose order a profile looks at.
MONOTONIC_ROWS = 10_000


def quality_score(columns: list[Profile], duplicate_rate: float, error: str | None = None) -> float:
    """As anomaly.quality, of an assembled profile; 0 for a failed table."""
    if error:
        return 0.0
    if not columns:
        return 100.0
    found = sum(len(c["anomalies"]) for c in columns)
    nulls = sum(c["null_rate"] for c in columns) / len(columns)
    return round(max(0.0, 100 - min(30, 3 * found) - min(20, 40 * nulls) - min(15, 100 * duplicate_rate)), 1)


def _by_column(df: DataFrame) -> dict[str, Profile]:
    return {r["column_name"]: {k: v for k, v in r.asDict(True).items() if k != "column_name"} for r in df.collect()}


def _lists(df: DataFrame, *order: str) -> dict[str, list[Profile]]:
    out: dict[str, list[Profile]] = defaultdict(list)
    for r in df.orderBy("column_name", *order).collect():
        out[r["column_name"]].append({k: v for k, v in r.asDict().items() if k != "column_name"})
    return out


def profile_table(df: DataFrame, info: TableInfo, config: Config | None = None, order: list[str] | None = None) -> Profile:
    """The profile of one table. ``order`` names columns by which rows are ordered; by default their place in files."""
    config, began = config or Config(), time.time()
    out: Profile = {"name": info.name, "comment": info.comment, "profiled_at": dt.datetime.now(dt.timezone.utc).isoformat(), "error": None}
    total = df.count()
    out |= {"total_row_count": total, "sample_size": config.sample_size, "columns": [], "correlations": [], "functional_dependencies": [], "duplicate_row_count": 0, "duplicate_rate": 0.0, "metric_errors": {}}
    columns: dict[str, Profile] = {c.name: {"name": c.name, "engine_type": c.engine_type, "canonical_type": c.canonical_type, "comment": c.comment, "nullable": c.nullable, "patterns": [], "pattern_scores": {}, "anomalies": [], "null_count": 0, "null_rate": 0.0} for c in info.columns}
    whole = config.sample_size == 0 or config.sample_size >= total
    out |= {"full_scan": whole, "sampled_row_count": total if whole else config.sample_size}
    if config.stats_depth == "fast" or not columns:
        return out | {"columns": list(columns.values()), "quality_score": 100.0, "duration_seconds": time.time() - began}
    few = df if whole else sample(df, config.sample_size, total, config.sample_method)
    if not whole and config.sample_method == "exact":
        few = few.cache()
    kind = lambda *kinds: [c for c, p in columns.items() if p["canonical_type"] in kinds]
    numbers, strings, bools, days, keyed, batch = kind(*NUMERIC), kind("string"), kind("boolean"), kind(*DATES), kind(*KEYED), config.column_batch_size

    def take(name: str, make: Callable[[], Any]) -> Any:
        """A metric that fails, or takes longer than the query timeout, is recorded; the others go on."""
        context, timer = df.sparkSession.sparkContext, None
        if config.query_timeout and (group := context.getLocalProperty("spark.jobGroup.id")):
            timer = threading.Timer(config.query_timeout, lambda: context.cancelJobGroup(group))
            timer.start()
        try:
            return make()
        except Exception as e:
            out["metric_errors"][name] = f"{type(e).__name__}: {str(e).splitlines()[0][:300]}"
            return None
        finally:
            if timer:
                timer.cancel()

    def merge(name: str, make: Callable[[], DataFrame]) -> None:
        for c, values in (take(name, lambda: _by_column(make())) or {}).items():
            columns[c] |= values

    merge("counts", lambda: core.counts(few, list(columns), batch))
    ordered = kind("string", "date", "datetime", "time")
    if ordered:
        merge("extremes", lambda: core.extremes(few, ordered, batch))
    if numbers:
        merge("numeric", lambda: core.numeric(few, numbers, batch))
        merge("moments", lambda: core.moments(few, numbers, config.bias_corrected_moments, batch))
        merge("quantiles", lambda: core.quantiles(few, numbers, config.exact_quantiles, batch=batch))
        merge("mad", lambda: dist.mad(few, numbers, exact=config.exact_quantiles or not whole))
    if strings:
        merge("strings", lambda: core.strings(few, strings, batch))
    if bools:
        merge("booleans", lambda: core.booleans(few, bools, batch))
    as_of = config.as_of or dt.date.today().isoformat()
    if days:
        merge("dates", lambda: core.dates(few, as_of, days, batch).drop("distinct_values"))
    if keyed:
        # one pass counts all values: of the whole table in exact mode, else of the sample
        counted = freq.grouped(df if config.exact_distinct else few, keyed).cache()
        merge("distinct", lambda: freq.distinct_of(counted))
        top = take("top_values", lambda: _lists(freq.ranked_of(counted, 10), "rank")) or {}
        bottom = take("bottom_values", lambda: _lists(freq.ranked_of(counted, 5, descending=False), "rank")) or {}
        bottom = {c: v for c, v in bottom.items() if len(v) == 5}
        counted.unpersist()
        if not config.exact_distinct and not whole:
            # distinct values are of the whole table even so, from sketches
            merge("approx_distinct", lambda: core.distincts(df, keyed, batch=batch).drop("distinct_mode"))
            for c in keyed:
                columns[c]["distinct_values"] = max(columns[c].get("distinct_values", 0), columns[c].get("approx_distinct", 0))
    for c, p in columns.items():
        exact = p.get("distinct_values", 0)
        p["distinct_mode"] = "exact" if config.exact_distinct or whole else "approx"
        p["approx_distinct"] = p.get("approx_distinct", exact)
        # a sketch may tell more values than there are rows
        p["distinct_ratio"] = round(min(1.0, exact / total), 6) if total else 0.0
        p["pk_candidate"] = bool(c in keyed and total and p["null_count"] == 0 and exact >= 0.99 * total)
        if p["canonical_type"] in NUMERIC and p.get("p25") is not None:
            p["iqr"], p["range"] = round(p["p75"] - p["p25"], 6), round(p["max"] - p["min"], 6)
            p["cv"] = round(abs(p["stddev"] / p["mean"]), 6) if p.get("stddev") is not None and p["mean"] else None
            p["box_plot"] = {"q1": p["p25"], "median": p["median"], "q3": p["p75"], "lower_fence": round(p["p25"] - 1.5 * p["iqr"], 6), "upper_fence": round(p["p75"] + 1.5 * p["iqr"], 6)}
        if c in keyed:
            p["top_values"] = [{"value": v["value"], "count": v["freq"]} for v in top.get(c, [])]
            p["bottom_values"] = [{"value": v["value"], "count": v["freq"]} for v in bottom.get(c, [])]
    if config.enable_patterns and strings:
        for c, found in (take("patterns", lambda: _lists(patterns.detect(few, strings), "pattern")) or {}).items():
            columns[c]["patterns"] = [f["pattern"] for f in found]
            columns[c]["pattern_scores"] = {f["pattern"]: f["score"] for f in found}
    if config.enable_histogram:
        if numbers:
            bins = take("histogram", lambda: _lists(dist.histogram(few, numbers, config.histogram_bins), "bin")) or {}
            for c, b in bins.items():
                columns[c]["histogram"] = [{k: x[k] for k in ("bin_start", "bin_end", "count")} for x in b]
                every, sum_ = sum(x["count"] for x in b), 0
                columns[c]["cdf"] = [{"x": x["bin_end"], "cumulative_pct": round((sum_ := sum_ + x["count"]) / every, 6)} for x in b]
            for name, make, by in (("kde", dist.densities, "x"), ("qq_plot", dist.quantile_plots, "theoretical")):
                found = take(name, lambda make=make, by=by: _lists(make(few, numbers), by)) or {}
                for c in numbers:
                    columns[c][name] = found.get(c)
        if strings:
            for c, b in (take("length_histogram", lambda: _lists(dist.length_histogram(few, strings), "length")) or {}).items():
                columns[c]["length_histogram"] = b
    lined = [c for c in keyed if columns[c]["canonical_type"] in (*NUMERIC, *DATES) and columns[c].get("distinct_values", 0) > 1]
    if lined:
        merge("monotonic", lambda: dist.monotonic(df, lined, order, MONOTONIC_ROWS))
    many = [c for c in numbers if columns[c].get("distinct_values", 0) > 100]
    if config.enable_benford and many:
        digits = take("benford", lambda: dist.benford_digits(few, many).cache())
        if digits is not None:
            for c, b in _lists(digits, "digit").items():
                columns[c]["benford_digits"] = [{k: x[k] for k in ("digit", "observed", "expected")} for x in b]
            for c, _, p in dist.benford_test(digits):
                columns[c]["benford_pvalue"] = p
            digits.unpersist()
    out |= take("completeness", lambda: rows.completeness(few).first().asDict()) or {}
    kinds = [c for c in kind("string", "integer", "boolean") if 1 < columns[c].get("distinct_values", 0) <= 50][:8]
    if len(kinds) > 1:
        found = take("functional_dependencies", lambda: assoc.functional_dependencies(df, kinds).orderBy("from_column", "to_column").collect()) or []
        out["functional_dependencies"] = [{"from": r[0], "to": r[1]} for r in found]
    if config.detect_duplicates:
        out |= take("duplicates", lambda: rows.duplicates(df, config.duplicate_column_limit).first().asDict()) or {}
    if config.enable_correlation:
        pairs: dict[tuple[str, str], Profile] = {}
        if len(numbers) > 1:
            for make in (assoc.pearson, assoc.spearman, assoc.nmi):
                for r in take(make.__name__, lambda make=make: make(few, numbers, config.correlation_max_columns).collect()) or []:
                    pairs.setdefault((r["col1"], r["col2"]), {"col1": r["col1"], "col2": r["col2"]}).update(r.asDict())
        some = [c for c in strings if 1 < columns[c].get("distinct_values", 0) < 50][:5]
        if len(some) > 1:
            for r in take("cramers_v", lambda: assoc.cramers_v(few, some, full_chi2=config.full_chi2).collect()) or []:
                pairs[(r["col1"], r["col2"])] = r.asDict()
        out["correlations"] = [{k: v for k, v in p.items() if v is not None} for p in pairs.values()]
    spark = df.sparkSession
    n = out["sampled_row_count"]
    inputs = spark.createDataFrame([{k: _cast(c.get(k), t) for k, t in anomaly.INPUTS.items()} | {"table_name": info.name, "column_name": c["name"], "total_rows": n, "as_of": dt.date.fromisoformat(as_of), "top_frequency": _share(c.get("top_frequency"), n, total if config.exact_distinct else n)} for c in columns.values()], ", ".join(f"{k} {t}" for k, t in anomaly.INPUTS.items()) + ", table_name string, column_name string")
    flagged = anomaly.flags(inputs, config.thresholds).cache()
    for r in flagged.select("column_name", "anomalies").collect():
        columns[r[0]]["anomalies"] = list(r[1])
    listed = [(c, v["value"]) for c, p in columns.items() if 2 <= p.get("distinct_values", 0) <= 10 and not set(p["patterns"]) & set(patterns.PERSONAL) for v in p.get("top_values", [])]
    values = spark.createDataFrame(listed, "column_name string, value string")
    out["suggested_constraints"] = [{"table": r["table_name"], "column": r["column_name"]} | {k: r[k] for k in ("constraint_type", "expression", "confidence", "evidence")} for r in anomaly.suggestions(flagged, values).orderBy("column_name", "constraint_type").collect()]
    flagged.unpersist()
    for p in columns.values():
        p["top_values"] = (p.get("top_values") or [])[:5]
        if set(p["patterns"]) & set(patterns.PERSONAL):
            for v in [*p["top_values"], *p.get("bottom_values", [])]:
                v["value"] = patterns.REDACTED
            p |= {k: patterns.REDACTED for k in ("min", "max") if p.get(k) is not None}
    out["columns"] = [{k: str(v) if isinstance(v, dt.date) else v for k, v in p.items()} for p in columns.values()]
    if not whole:
        few.unpersist()
    return out | {"quality_score": quality_score(out["columns"], out["duplicate_rate"]), "duration_seconds": round(time.time() - began, 3)}


def _share(top: int | None, n: int, total: int) -> int | None:
    return None if top is None else round(top * n / total) if total else 0


def _cast(v: Any, kind: str) -> Any:
    if v is None:
        return None
    return {"string": str, "double": float, "long": int}.get(kind, lambda x: x)(v)


def run_profiler(spark: SparkSession, config: Config, progress: Callable[[str, str], None] | None = None) -> tuple[str, list[Profile]]:
    """Profiles the source's tables and writes the output. Returns the run's id and the profiles.

    Tables run in parallel driver threads. Each finished one is stored at once, so that ``resume`` only does the rest;
    ``incremental`` takes over the stored profile of tables that did not change.
    """
    from ..sinks import writers

    source = Source.open(spark, config.source_kind, config.source, config.schema_name)
    run_id = config.resume or uuid.uuid4().hex[:12]
    state = incremental.StateStore(config.state_dir) if config.state_dir else None
    names = [t for t in source.tables() if config.tables is None or t in config.tables]
    prior_id = config.prior_run_id or (state.latest_run_id(config.database, config.schema_name) if state and config.incremental else None)
    done = state.finished(run_id) if state and config.resume else set()

    def one(name: str) -> Profile:
        if name in done and (kept := state.get(run_id, name)):
            return kept["profile"]
        if state:
            state.mark(run_id, name, "in_progress")
        try:
            spark.sparkContext.setJobGroup(f"{run_id}-{name}", f"profile of {name}", True)
            info, df = discover(source, name), source.read(name)
            prior = state.get(prior_id, name) if state and prior_id else None
            change = incremental.check_delta(df, info, prior, config.watermark_column)
            if config.incremental and prior and not change.changed:
                found, status = prior["profile"], "skipped"
            else:
                found, status = profile_table(df, info, config), "done"
                declared = config.constraints.get(name) or (source.constraints(name) if config.discover_constraints else {})
                found["constraints"] = declared or None
            if state:
                state.put(run_id, name, found, change, config.database, config.schema_name)
                state.mark(run_id, name, status)
        except Exception as e:
            found = {"name": name, "columns": [], "error": f"{type(e).__name__}: {str(e).splitlines()[0][:500]}", "quality_score": 0.0, "total_row_count": 0, "duplicate_row_count": 0, "duplicate_rate": 0.0}
            if state:
                state.mark(run_id, name, "error", found["error"])
        if progress:
            progress(name, found.get("error") or "done")
        return found

    with ThreadPoolExecutor(config.concurrency) as pool:
        profiles = list(pool.map(one, names))
    related = relationships.discover_relationships(profiles, source.read if config.discover_relationships else None) if config.discover_relationships else []
    by_table = defaultdict(list)
    for s in relationships.suggest_foreign_keys(related):
        by_table[s["table"]].append(s)
    for p in profiles:
        own = [s for s in p.get("suggested_constraints") or [] if s["constraint_type"] != "FOREIGN KEY"]
        p["suggested_constraints"] = own + by_table[p["name"]]
    if config.output:
        writers.write(config.output_format, config.output, profiles, related, {"run_id": run_id, "engine": "spark", "database": config.database, "schema": config.schema_name}, spark)
    return run_id, profiles
