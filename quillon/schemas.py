"""Types of the tables that jobs exchange, and the rules that rows of each must keep."""

from __future__ import annotations

from pyspark.sql import types as T

from .config import RAW_COLUMNS

_S, _L, _D, _I, _B = T.StringType(), T.LongType(), T.DoubleType(), T.IntegerType(), T.BooleanType()


def _struct(*fields: tuple[str, T.DataType] | tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(f[0], f[1], len(f) < 3 or f[2]) for f in fields])


RAW_FILE = _struct(*((name, _S) for name in RAW_COLUMNS), ("_corrupt", _S))

CONTACT_EVENT = _struct(
    ("event_id", _S), ("event_ts", T.TimestampType()), ("event_date", T.DateType()), ("request_id", _S), ("contact_id", _S),
    ("campaign_id", _S), ("context_features", T.MapType(_S, _S)), ("source_name", _S),
)
SUBSCRIPTION_LABEL = _struct(
    ("label_event_id", _S), ("parent_event_id", _S), ("label_ts", T.TimestampType()), ("label_date", T.DateType()), ("subscribed", _I),
    ("attribution_window_hours", _I), ("label_delay_seconds", _I), ("source_name", _S),
)
TRAINING_ROW = _struct(
    ("training_row_id", _S), ("snapshot_date", T.DateType()), ("event_id", _S), ("event_ts", T.TimestampType()), ("label_ts", T.TimestampType()),
    ("label_available", _B), ("label", _I), ("sample_weight", _D), ("dense_features", T.ArrayType(_D)), ("sparse_feature_ids", T.ArrayType(_L)),
    ("sparse_feature_values", T.ArrayType(_D)), ("feature_set_version", _S), ("task_context", _S),
)
FEATURE_VECTOR = _struct(
    ("request_id", _S), ("event_id", _S), ("event_ts", _S), ("task_context", _S), ("feature_set_version", _S), ("hash_dimension", _L),
    ("dense_feature_names", T.ArrayType(_S)), ("dense_features", T.ArrayType(_D)), ("sparse_feature_ids", T.ArrayType(_L)),
    ("sparse_feature_values", T.ArrayType(_D)), ("dense_feature_count", _I), ("sparse_feature_count", _I),
)
PREDICTION_LOG = _struct(
    ("prediction_id", _S), ("prediction_date", T.DateType()), ("prediction_ts", T.TimestampType()), ("request_id", _S), ("event_id", _S),
    ("model_version", _S), ("calibration_version", _S), ("feature_set_version", _S), ("feature_vector", FEATURE_VECTOR), ("raw_score", _D),
    ("calibrated_score", _D), ("decision_policy_version", _S), ("latency_ms", _D), ("task_context", _S),
)
DECISION_OUTCOME = _struct(
    ("decision_id", _S), ("decision_date", T.DateType()), ("decision_ts", T.TimestampType()), ("prediction_id", _S), ("task_context", _S),
    ("action", _S), ("action_reason", _S), ("threshold_value", _D), ("manual_review_required", _B), ("realized_label", _I),
    ("realized_value", _D), ("outcome_delay_days", _I), ("calibrated_probability", _D), ("raw_probability", _D),
)
REQUEST_FEATURES = [name for name in RAW_COLUMNS if name != "y"]
REQUEST = _struct(
    ("request_id", _S), ("event_id", _S), ("event_ts", _S), ("task_context", _S), ("realized_label", _I), ("realized_value", _D),
    ("calibrated_probability", _D), ("features", _struct(*((name, _S) for name in REQUEST_FEATURES))), *((name, _S) for name in REQUEST_FEATURES),
)
