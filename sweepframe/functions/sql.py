"""Functions for SQL users, as temporary functions of a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Name, parameters, kind of result and body of each function.
FUNCTIONS = {
    "wrap_angle": ("a DOUBLE", "DOUBLE", "pmod(a + pi(), 2 * pi()) - pi()"),
    "heading_difference": ("a DOUBLE, b DOUBLE", "DOUBLE", "degrees(abs(pmod(a - b + pi(), 2 * pi()) - pi()))"),
    "axis_difference": ("a DOUBLE, b DOUBLE", "DOUBLE", "degrees(abs(pmod(a - b + pi() / 2, pi()) - pi() / 2))"),
    "cell_index": ("v DOUBLE, low DOUBLE, size DOUBLE", "INT", "CAST(floor((v - low) / size) AS INT)"),
    "stamp_ns": ("seconds BIGINT, nanoseconds BIGINT", "BIGINT", "seconds * 1000000000 + nanoseconds"),
}


def register(spark: SparkSession) -> list[str]:
    """Makes FUNCTIONS known to the session; their bodies are built-in expressions, so plans show no call. Gives their names."""
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    return list(FUNCTIONS)
