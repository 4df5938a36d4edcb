"""Sources: Parquet directories, catalog schemas and JDBC databases; discovery and sampling."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import col, quoted
from ..types import canonical_of


@dataclass
class ColumnInfo:
    name: str
    engine_type: str
    canonical_type: str
    nullable: bool = True
    comment: str | None = None


@dataclass
class TableInfo:
    name: str
    columns: list[ColumnInfo] = field(default_factory=list)
    comment: str | None = None


class Source:
    """Tables by name. Subclasses list and read them; ``register`` adds further kinds."""

    kinds: dict[str, type[Source]] = {}

    def __init__(self, spark: SparkSession, location: str, schema: str | None = None, **options: str):
        self.spark, self.location, self.schema, self.options = spark, location, schema, options

    @classmethod
    def register(cls, kind: str):
        def add(sub: type[Source]) -> type[Source]:
            cls.kinds[kind] = sub
            return sub

        return add

    @classmethod
    def open(cls, spark: SparkSession, kind: str, location: str, schema: str | None = None, **options: str) -> Source:
        if kind not in cls.kinds:
            raise ValueError(f"no source {kind!r}; there are {', '.join(sorted(cls.kinds))}")
        return cls.kinds[kind](spark, location, schema, **options)

    def tables(self) -> list[str]:
        raise NotImplementedError

    def read(self, table: str) -> DataFrame:
        raise NotImplementedError

    def comment(self, table: str) -> str | None:
        return None

    def constraints(self, table: str) -> dict:
        """Declared constraints; Parquet has none."""
        return {}


@Source.register("parquet")
class ParquetSource(Source):
    """A folder of NAME.parquet files or folders, listed through Hadoop's file systems."""

    def tables(self) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.location)
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(path)
        return sorted(n[: -len(".parquet")] for n in (s.getPath().getName() for s in found) if n.endswith(".parquet"))

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.location}/{table}.parquet")


class FileSource(ParquetSource):
    """As ParquetSource for other formats of Spark's readers."""

    kind = "orc"

    def tables(self) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.location)
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(path)
        return sorted(n[: -len(self.kind) - 1] for n in (s.getPath().getName() for s in found) if n.endswith("." + self.kind))

    def read(self, table: str) -> DataFrame:
        return self.spark.read.format(self.kind).options(**self.options).load(f"{self.location}/{table}.{self.kind}")


for _kind in ("orc", "csv", "json"):
    Source.register(_kind)(type(f"{_kind.title()}Source", (FileSource,), {"kind": _kind}))


@Source.register("catalog")
class CatalogSource(Source):
    """Base tables of a schema of Spark's catalog; views are left out."""

    def tables(self) -> list[str]:
        found = self.spark.catalog.listTables(self.schema or self.location or None)
        return sorted(t.name for t in found if t.tableType != "VIEW" and not t.isTemporary)

    def read(self, table: str) -> DataFrame:
        at = self.schema or self.location
        return self.spark.table(f"{quoted(at)}.{quoted(table)}" if at else quoted(table))

    def comment(self, table: str) -> str | None:
        at = self.schema or self.location
        return self.spark.catalog.getTable(f"{at}.{table}" if at else table).description


@Source.register("jdbc")
class JdbcSource(Source):
    """A database with a JDBC driver on the class path; tables and constraints come from its information schema."""

    def _query(self, sql: str) -> DataFrame:
        return self.spark.read.format("jdbc").options(url=self.location, query=sql, **self.options).load()

    def _where(self) -> str:
        return f"table_schema = '{self.schema.replace(chr(39), chr(39) * 2)}'" if self.schema else "table_schema NOT IN ('information_schema', 'pg_catalog')"

    def tables(self) -> list[str]:
        rows = self._query(f"SELECT table_name FROM information_schema.tables WHERE table_type = 'BASE TABLE' AND {self._where()}")
        return sorted(r[0] for r in rows.collect())

    def read(self, table: str) -> DataFrame:
        name = '"' + table.replace('"', '""') + '"'
        at = '"' + self.schema.replace('"', '""') + '".' if self.schema else ""
        return self.spark.read.format("jdbc").options(url=self.location, dbtable=at + name, **self.options).load()

    def constraints(self, table: str) -> dict:
        rows = self._query(
            "SELECT tc.constraint_type AS kind, tc.constraint_name AS name, k.column_name AS col, u.table_name AS rt, u.column_name AS rc, k.ordinal_position AS pos "
            "FROM information_schema.table_constraints tc JOIN information_schema.key_column_usage k ON k.constraint_name = tc.constraint_name AND k.table_name = tc.table_name "
            "LEFT JOIN information_schema.constraint_column_usage u ON u.constraint_name = tc.constraint_name "
            f"WHERE tc.table_name = '{table.replace(chr(39), chr(39) * 2)}' AND tc.{self._where()}"
        ).collect()
        out: dict = {"primary_key": [], "foreign_keys": [], "unique_constraints": [], "check_constraints": []}
        for name in sorted({r["name"] for r in rows}):
            own = sorted((r for r in rows if r["name"] == name), key=lambda r: r["pos"])
            cols = list(dict.fromkeys(r["col"] for r in own))
            if own[0]["kind"] == "PRIMARY KEY":
                out["primary_key"] = cols
            elif own[0]["kind"] == "UNIQUE":
                out["unique_constraints"].append({"name": name, "columns": cols})
            elif own[0]["kind"] == "FOREIGN KEY":
                out["foreign_keys"].append({"constrained_columns": cols, "referred_table": own[0]["rt"], "referred_columns": list(dict.fromkeys(r["rc"] for r in own))})
        return out


def discover(source: Source, table: str) -> TableInfo:
    """Columns with types and comments; a table that cannot be read has none."""
    try:
        schema = source.read(table).schema
    except Exception:
        return TableInfo(table)
    return TableInfo(table, [ColumnInfo(f.name, f.dataType.simpleString(), canonical_of(f.dataType), f.nullable, (f.metadata or {}).get("comment")) for f in schema.fields], source.comment(table))


def row_count(df: DataFrame) -> int:
    return df.count()


def row_place(df: DataFrame) -> list[Column] | None:
    """What tells the rows of a table of files apart, wherever they are read; null for other tables."""
    place = [F.col("_metadata.file_name"), F.col("_metadata.row_index")]
    try:
        df.select(*place)
    except AnalysisException:
        return None
    return place


def _least(df: DataFrame, n: int) -> DataFrame:
    """n rows in the order of a hash, the same ones whenever and however they are read.

    Rows of files are hashed by their place. Others are hashed by their values and a number for each copy of equal rows,
    which are counted before they are shuffled; tables with maps by the order in which they come.
    """
    place = row_place(df)
    if place is None and any(f.dataType.simpleString().startswith(("map", "variant")) for f in df.schema.fields):
        place = [F.monotonically_increasing_id()]
    if place is not None:
        rows = df.select(F.struct(*[col(c).alias(c) for c in df.columns]).alias("row"), *place).toDF("row", *[f"p{i}" for i in range(len(place))])
        by = [F.col(c) for c in rows.columns[1:]]
        return rows.orderBy(F.xxhash64(F.lit(42), *by), *by).limit(n).select("row.*")
    rows = df.select(F.struct(*[col(c).alias(c) for c in df.columns]).alias("row")).groupBy("row").agg(F.count("*").alias("copies"))
    rows = rows.select("row", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(n)))).alias("copy"))
    return rows.orderBy(F.xxhash64(F.lit(42), "copy", "row"), "copy", "row").limit(n).select("row.*")


def sample(df: DataFrame, n: int, total: int | None = None, method: str = "exact", seed: int = 42) -> DataFrame:
    """A sample of n rows; all rows if n is 0 or not below the total.

    ``exact``: n rows by a hash, the same ones whenever they are read; repeated rows are drawn as often as others.
    ``bernoulli``: each row with probability n / total. ``random``: n rows in the order of a seeded random number.
    """
    total = df.count() if total is None else total
    if n == 0 or n >= total:
        return df
    if method == "exact":
        return _least(df, n)
    if method == "bernoulli":
        return df.sample(fraction=min(1.0, n / total), seed=seed)
    if method == "random":
        return df.orderBy(F.rand(seed)).limit(n)
    raise ValueError(f"no sampling method {method!r}")


def limited_values(df: DataFrame, column: str, limit: int = 10_000) -> DataFrame:
    """Up to ``limit`` values of a numeric column as double, drawn as ``sample`` draws rows."""
    x = col(column).cast("double")
    place = row_place(df)
    some = df.where(x.isNotNull())
    if place is None:
        return _least(some.select(x.alias("value")), limit)
    rows = some.select(x, *place).toDF("value", "p0", "p1")
    return rows.orderBy(F.xxhash64(F.lit(42), "p0", "p1"), "p0", "p1").limit(limit).select("value")
