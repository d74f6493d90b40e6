"""The engine's expressions as temporary SQL functions of a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

_VECTOR = "ARRAY<DOUBLE>"
FUNCTIONS = {
    "vector_dot": (f"a {_VECTOR}, b {_VECTOR}", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"),
    "vector_l2_squared": (f"a {_VECTOR}, b {_VECTOR}", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x)"),
    "vector_norm": (f"v {_VECTOR}", "DOUBLE", "sqrt(aggregate(v, 0D, (s, x) -> s + x * x))"),
    "vector_normalize": (
        f"v {_VECTOR}", _VECTOR,
        "transform(array(sqrt(aggregate(v, 0D, (s, x) -> s + x * x))), n -> transform(v, x -> CASE WHEN n = 0 THEN x ELSE x / n END))[0]",
    ),
    "fuzz_ratio": (
        "a STRING, b STRING", "DOUBLE",
        """CASE WHEN char_length(a) + char_length(b) = 0 THEN 100D WHEN char_length(a) = 0 OR char_length(b) = 0 THEN 0D
        ELSE 200D * element_at(aggregate(split(a, ''), array_repeat(0, char_length(b) + 1), (row, ch) ->
            aggregate(sequence(1, char_length(b)), array(0), (acc, j) -> concat(acc, array(
                CASE WHEN substring(b, j, 1) = ch THEN row[j - 1] + 1 ELSE greatest(row[j], acc[j - 1]) END)))), -1)
            / (char_length(a) + char_length(b)) END""",
    ),
}


def register(spark: SparkSession) -> None:
    """Make the functions callable from spark.sql."""
    for name, (arguments, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
