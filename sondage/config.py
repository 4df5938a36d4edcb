"""Settings of a profiling run."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class Thresholds:
    """Limits of the anomaly rules."""

    high_null_rate: float = 0.5
    near_constant_rate: float = 0.95
    high_cardinality_distinct: int = 10_000
    all_unique_ratio: float = 0.99
    all_unique_hll_guard: float = 1.05
    skewness: float = 2.0

    def __post_init__(self):
        for name, low, high in (("high_null_rate", 0, 1), ("near_constant_rate", 0.5, 1), ("all_unique_ratio", 0.9, 1), ("all_unique_hll_guard", 1, 1.2), ("high_cardinality_distinct", 1, float("inf"))):
            if not low <= getattr(self, name) <= high:
                raise ValueError(f"{name} must lie between {low} and {high}")


#: Output formats and the endings of their files.
FORMATS = {"json": "ndjson", "parquet": "parquet", "yaml": "yaml", "csv": "csv", "html": "html", "jsonld": "jsonld", "graphml": "graphml", "openmetadata": "json"}


@dataclass
class Config:
    """What to profile and how. ``sample_size`` 0 scans whole tables; ``as_of`` is the day that ages are counted to."""

    source: str = ""
    source_kind: str = "parquet"
    database: str | None = None
    schema_name: str | None = None
    tables: list[str] | None = None
    sample_size: int = 10_000
    sample_method: str = "exact"
    concurrency: int = 4
    stats_depth: str = "full"
    exact_distinct: bool = False
    exact_quantiles: bool = False
    column_batch_size: int = 80
    output_format: str = "json"
    output: str | None = None
    state_dir: str | None = None
    resume: str | None = None
    incremental: bool = False
    watermark_column: str | None = None
    prior_run_id: str | None = None
    enable_patterns: bool = True
    discover_constraints: bool = True
    discover_relationships: bool = True
    detect_duplicates: bool = True
    duplicate_column_limit: int = 50
    enable_histogram: bool = True
    histogram_bins: int = 10
    enable_correlation: bool = True
    correlation_max_columns: int = 20
    enable_benford: bool = True
    query_timeout: int = 300
    as_of: str | None = None
    bias_corrected_moments: bool = False
    full_chi2: bool = False
    constraints: dict = field(default_factory=dict)
    thresholds: Thresholds = field(default_factory=Thresholds)

    def __post_init__(self):
        if self.stats_depth not in ("full", "fast"):
            raise ValueError("stats_depth is full or fast")
        if self.output_format not in FORMATS:
            raise ValueError(f"output_format is one of {', '.join(FORMATS)}")
        if not 2 <= self.histogram_bins <= 100:
            raise ValueError("histogram_bins lies between 2 and 100")
        for name, least in (("sample_size", 0), ("concurrency", 1), ("column_batch_size", 1), ("duplicate_column_limit", 1), ("correlation_max_columns", 2), ("query_timeout", 0)):
            if getattr(self, name) < least:
                raise ValueError(f"{name} is at least {least}")
