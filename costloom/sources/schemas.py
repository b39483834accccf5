"""Schemas of the tables that jobs read and write."""

from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType, TimestampType

_TYPES = {"long": LongType(), "int": IntegerType(), "double": DoubleType(), "string": StringType(), "timestamp": TimestampType()}


def _schema(text: str) -> StructType:
    """From "name type, name type"; needs no session."""
    pairs = (part.split() for part in text.split(","))
    return StructType([StructField(name, _TYPES[kind]) for name, kind in pairs])


USAGE = _schema(
    "id long, project_id long, timestamp timestamp, model string, provider string, tokens_in long, tokens_out long, cost_usd double, metadata string, source string"
)
PROJECTS = _schema(
    "id long, name string, path string, baseline_daily_cost double, baseline_total_days int, baseline_total_cost double, metadata string, created_at timestamp"
)
FORECASTS = _schema(
    "project_id long, iteration int, projected_total double, projected_remaining_days int, smoothed_burn_ratio double, confidence string, active_days_count int, mase double, created_at timestamp"
)
RAW = _schema("project_id long, received_at timestamp, content_type string, body string")
FILES = _schema("project_id long, path string, content string")
PROJECT_METADATA = "struct<project_type:string,model:string,confidence:string,calls_per_day:long,tokens_in:long,tokens_out:long,budget:double>"
EXPORT_COLUMNS = ["timestamp", "model", "provider", "tokens_in", "tokens_out", "cost_usd"]
JSON_COLUMNS = ["id", "project_id", "timestamp", "model", "provider", "tokens_in", "tokens_out", "cost_usd", "metadata"]
