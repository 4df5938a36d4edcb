"""Whole runs, relationships, increments and outputs."""

import json
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from sondage.config import Config
from sondage.operators.core import sketches
from sondage.plans import graph, incremental, relationships
from sondage.plans.profile import profile_table, quality_score, run_profiler
from sondage.sources.readers import ParquetSource, Source, discover
from sondage.streaming import profile_stream


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    users = spark.range(0, 120).select(F.col("id").alias("user_id"), F.concat(F.lit("u"), "id", F.lit("@x.org")).alias("mail"), (F.col("id") % 3).cast("string").alias("kind"), (F.col("id") * 1.5).alias("score"))
    users.coalesce(1).write.parquet(f"{at}/users.parquet")
    spark.range(0, 300).select((F.col("id") % 120).alias("user_id"), F.lit("a b").alias("note")).coalesce(1).write.parquet(f"{at}/visits.parquet")
    spark.createDataFrame([], "a long, b string").write.parquet(f"{at}/empty.parquet")
    return str(at)


def test_run_and_outputs(spark, folder, tmp_path):
    config = Config(source=folder, sample_size=0, as_of="2025-01-01", exact_distinct=True, output=f"{tmp_path}/out.ndjson", state_dir=f"{tmp_path}/state")
    run_id, profiles = run_profiler(spark, config)
    by = {p["name"]: p for p in profiles}
    assert {n: (p["total_row_count"], p["error"]) for n, p in by.items()} == {"users": (120, None), "visits": (300, None), "empty": (0, None)}
    assert not by["users"]["metric_errors"] and not by["empty"]["metric_errors"]
    cols = {c["name"]: c for c in by["users"]["columns"]}
    assert cols["user_id"]["pk_candidate"] and cols["mail"]["patterns"] == ["email"] and cols["mail"]["top_values"][0]["value"] == "[REDACTED]"
    assert by["visits"]["duplicate_row_count"] == 180
    related = [json.loads(x) for x in open(config.output)][-1]["relationships"]
    assert [(r["source_table"], r["target_table"], r["relationship_type"]) for r in related] == [("visits", "users", "semantic_fk")] or related[0]["target_table"] == "users"
    assert any(s["constraint_type"] == "FOREIGN KEY" for s in by["visits"]["suggested_constraints"])
    again, later = run_profiler(spark, Config(source=folder, sample_size=0, as_of="2025-01-01", incremental=True, state_dir=f"{tmp_path}/state"))
    assert again != run_id and {p["name"]: p["total_row_count"] for p in later} == {"users": 120, "visits": 300, "empty": 0}
    assert incremental.StateStore(f"{tmp_path}/state").finished(again) == {"users", "visits", "empty"}
    for kind in ("yaml", "parquet", "csv", "jsonld", "graphml", "openmetadata", "html"):
        from sondage.sinks import writers

        writers.write(kind, f"{tmp_path}/o.{kind}", profiles, related, {"run_id": run_id, "database": "My DB", "schema": None, "engine": "spark"}, spark)
    assert spark.read.parquet(f"{tmp_path}/o.parquet").count() == 8
    assert len(ET.parse(f"{tmp_path}/o.graphml").getroot().findall(".//{*}node")) == 2 + 3 + 8
    assert json.load(open(f"{tmp_path}/o.openmetadata"))["openMetadataExport"] is True
    assert json.load(open(f"{tmp_path}/o.jsonld"))["@graph"][0]["@id"] == "urn:profiler:my_db"
    page = open(f"{tmp_path}/o.html").read()
    assert "<script" not in page and "users" in page


def test_fast_mode_and_missing_table(spark, folder):
    source = Source.open(spark, "parquet", folder)
    p = profile_table(source.read("users"), discover(source, "users"), Config(stats_depth="fast"))
    assert p["total_row_count"] == 120 and "min" not in p["columns"][0]
    assert discover(source, "none").columns == []
    with pytest.raises(ValueError):
        Source.open(spark, "nothing", folder)


def test_html_is_escaped(tmp_path):
    from sondage.sinks import writers

    bad = {"name": "<script>x</script>", "columns": [], "total_row_count": 1, "quality_score": 1, "error": None}
    writers.write("html", f"{tmp_path}/x.html", [bad], [], {})
    assert "<script" not in open(f"{tmp_path}/x.html").read()


def _table(name, **columns):
    return {"name": name, "columns": [{"name": c, "canonical_type": t, "anomalies": ["all_unique"] if u else []} for c, (t, u) in columns.items()]}


def test_semantic_relationships():
    sales = _table("store_sales", ss_customer_sk=("integer", False), ss_date_sk=("integer", False))
    customer = _table("customer", c_customer_sk=("integer", True), c_first_name=("string", False))
    dates = _table("date_dim", date_sk=("integer", True))
    found = {(r["source_columns"][0], r["target_table"], r["relationship_type"], r["confidence"]) for r in relationships.discover_relationships([sales, customer, dates])}
    assert found == {("ss_customer_sk", "customer", "semantic_fk", 0.6), ("ss_date_sk", "date_dim", "semantic_fk", 0.6)}
    text = _table("customer", c_customer_sk=("string", True))
    assert relationships.discover_relationships([sales, text]) == []
    assert [relationships.entity_of(x) for x in ("ss_customer_sk", "ws_ship_key", "customer_sk", "name")] == [("customer", "_sk"), ("ship", "_key"), ("customer", "_sk"), None]


def test_composite_and_declared():
    keys = {"inv_item_sk": ("integer", False), "inv_warehouse_sk": ("integer", False)}
    inventory = _table("inventory", **keys) | {"constraints": {"primary_key": list(keys)}}
    found = relationships.discover_relationships([inventory, _table("inventory_snapshot", **keys)])
    assert [(r["relationship_type"], r["confidence"]) for r in found] == [("inferred_composite", 0.5)]
    declared = _table("a", x=("integer", False)) | {"constraints": {"foreign_keys": [{"constrained_columns": ["x"], "referred_table": "b", "referred_columns": ["x"]}]}}
    assert [r["relationship_type"] for r in relationships.discover_relationships([declared, _table("b", x=("integer", True))])] == ["declared_fk"]


def test_merge_and_hash():
    c = lambda n, mean, var, **k: {"name": "t", "total_row_count": n, "columns": [{"name": "v", "null_count": 0, "mean": mean, "variance": var, "patterns": [], "anomalies": []} | k]}
    out = incremental.merge_profiles(c(100, 0.0, 0.0, min=1, approx_distinct=5), c(100, 10.0, 0.0, min=-1, approx_distinct=9))["columns"][0]
    assert (out["mean"], out["variance"], out["stddev"], out["min"], out["approx_distinct"]) == (5.0, 25.0, 5.0, -1, 9)
    assert incremental.column_hash([("a", "x"), ("b", "y")]) == incremental.column_hash([("b", "y"), ("a", "x")]) != incremental.column_hash([("a", "x")])
    assert quality_score([], 0) == 100.0 and quality_score([], 0, "failed") == 0.0


def test_partials_and_stream(spark, folder, tmp_path):
    stream = spark.readStream.schema(spark.read.parquet(f"{folder}/users.parquet").schema).parquet(f"{folder}/users.parquet")
    profile_stream.write_partials(stream, ["score"], f"{tmp_path}/parts", f"{tmp_path}/ckpt").awaitTermination()
    r = profile_stream.current(spark, f"{tmp_path}/parts").first()
    whole = spark.read.parquet(f"{folder}/users.parquet").agg(F.avg("score"), F.stddev_samp("score")).first()
    assert (r["rows"], r["mean"]) == (120, pytest.approx(whole[0])) and r["stddev"] == pytest.approx(whole[1])
    assert sketches(spark.range(10).toDF("x"), ["x"]).select(F.hll_sketch_estimate("sketch")).first()[0] == 10


def test_graph_counts():
    nodes, edges = graph.build([], [], "mydb", "public")
    assert (len(nodes), len(edges)) == (2, 1)
    p = {"name": "users", "columns": [{"name": "email address"}], "correlations": [{"col1": "email address", "col2": "email address", "pearson": 0.9}]}
    nodes, edges = graph.build([p], [], "mydb", "public")
    assert len(nodes) == 4 and nodes[-1]["id"] == "urn:profiler:mydb:public:users:email_address" and edges[-1]["label"] == "SIMILAR_TO"


def test_discovery_lists_tables(spark, folder):
    assert ParquetSource(spark, folder).tables() == ["empty", "users", "visits"]


def test_watermarks_are_compared_in_their_type(spark):
    df = spark.createDataFrame([(9, "a"), (10, "b")], "n long, s string")
    info = discover(type("S", (), {"read": lambda self, t: df, "comment": lambda self, t: None})(), "t")
    now = incremental.column_hash([(c.name, c.canonical_type) for c in info.columns])
    reason = lambda old, column="n": incremental.check_delta(df, info, {"column_hash": now, "row_count": 2, "watermark_value": old}, column).reason
    assert [reason("9"), reason("10"), reason("11"), reason("x"), reason(None), reason("a", "s"), reason("b", "s")] == ["watermark_advanced", "unchanged", "watermark_advanced", "watermark_advanced", "unchanged", "watermark_advanced", "unchanged"]


def test_merged_deviations_far_from_zero(spark):
    df = spark.range(0, 1000).select((F.col("id") % 7).alias("part"), (F.col("id") * 0.5 + 1e9).alias("x"), F.when(F.col("id") % 3 == 0, F.lit("k")).alias("key"))
    whole = df.agg(F.var_pop("x") * 1000).first()[0]
    merged = incremental.merge_partials(incremental.partials(df, ["x"], "part").drop("part")).first()
    assert merged["m2"] == pytest.approx(whole, rel=1e-9) and merged["mean"] == pytest.approx(1e9 + 249.75, rel=1e-15)
    by_key = incremental.merge_partials(incremental.partials(df, ["x"], "part", "key"), "key").collect()
    assert {(r["key"], r["non_null"]) for r in by_key} == {("k", 334), (None, 666)}
