import pytest
from pyspark.sql import types as T

from sondage.config import Config, Thresholds
from sondage.types import canonical_of, map_type


@pytest.mark.parametrize(
    ("name", "kind"),
    [
        ("VARCHAR", "string"), ("varchar(255)", "string"), (" text ", "string"), ("BIGINT", "integer"), ("UINTEGER", "integer"), ("HUGEINT", "integer"), ("NUMBER(38,0)", "integer"),
        ("NUMERIC(18, 0)", "integer"), ("NUMBER(38,2)", "float"), ("NUMERIC(10,4)", "float"), ("DECIMAL(18,0)", "float"), ("NUMBER", "float"), ("DOUBLE", "float"), ("BIT", "boolean"),
        ("TIMESTAMP_NTZ", "datetime"), ("TIMESTAMP(6)", "datetime"), ("DATE", "date"), ("BYTEA", "binary"), ("TIME", "time"), ("VARIANT", "semi_structured"), ("INTERVAL", "semi_structured"),
        ("STRUCT<a:int>", "unknown"), ("INTEGER[]", "unknown"), ("DOUBLE PRECISION", "unknown"), ("", "unknown"),
    ],
)
def test_map_type(name, kind):
    assert map_type(name) == kind


def test_spark_types():
    kinds = {T.LongType(): "integer", T.DecimalType(10, 0): "float", T.StringType(): "string", T.BooleanType(): "boolean", T.TimestampNTZType(): "datetime", T.DateType(): "date", T.BinaryType(): "binary", T.ArrayType(T.LongType()): "semi_structured", T.NullType(): "semi_structured"}
    assert {k: canonical_of(k) for k in kinds} == kinds


def test_config_limits():
    for bad in ({"sample_size": -1}, {"stats_depth": "deep"}, {"output_format": "xls"}, {"histogram_bins": 1}, {"correlation_max_columns": 1}):
        with pytest.raises(ValueError):
            Config(**bad)
    with pytest.raises(ValueError):
        Thresholds(high_null_rate=2)
