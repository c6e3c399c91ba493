"""Column expressions and small filters built from Spark's own functions."""

from tunestrata.functions.columns import (
    binarize_label,
    count_nan,
    drop_nan,
    feature_columns,
    hash_bucket,
    hash_fraction,
    strip_quotes,
)

__all__ = [
    "binarize_label",
    "count_nan",
    "drop_nan",
    "feature_columns",
    "hash_bucket",
    "hash_fraction",
    "strip_quotes",
]
