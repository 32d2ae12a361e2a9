"""The histogram and its percentiles as SQL functions of a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from netlens.functions.histogram import BOUNDS, OVERFLOW

_N = len(BOUNDS) + 1
_BUCKET = " ".join(f"WHEN v <= {high} THEN {i}" for i, high in enumerate(BOUNDS))

#: Name, arguments, result and body of each function.
FUNCTIONS = {
    "netlens_bucket": ("v DOUBLE", "INT", f"CASE WHEN v IS NULL THEN NULL {_BUCKET} ELSE {_N - 1} END"),
    "netlens_counters": ("entries ARRAY<STRUCT<bucket: INT, n: BIGINT>>", "ARRAY<BIGINT>",
                         f"transform(sequence(0, {_N - 1}), i -> aggregate(filter(entries, e -> e.bucket = i), 0L, (a, e) -> a + e.n))"),
    "netlens_merge": ("a ARRAY<BIGINT>, b ARRAY<BIGINT>", "ARRAY<BIGINT>", f"transform(sequence(0, {_N - 1}), i -> coalesce(get(a, i), 0L) + coalesce(get(b, i), 0L))"),
    "netlens_rank_bucket": ("h ARRAY<BIGINT>, p INT", "INT",
                            f"array_position(transform(sequence(1, {_N}), i -> aggregate(slice(h, 1, i), 0L, (a, x) -> a + x) >= (aggregate(h, 0L, (a, x) -> a + x) * p + 99) div 100), true)"),
    "netlens_percentile": ("h ARRAY<BIGINT>, p INT", "DOUBLE",
                           f"""CASE WHEN aggregate(h, 0L, (a, x) -> a + x) = 0 THEN 0D WHEN netlens_rank_bucket(h, p) = {_N} THEN {OVERFLOW}D ELSE
 (1D - (aggregate(slice(h, 1, netlens_rank_bucket(h, p)), 0L, (a, x) -> a + x) - (aggregate(h, 0L, (a, x) -> a + x) * p + 99) div 100) / h[netlens_rank_bucket(h, p) - 1])
 * (shiftleft(1, netlens_rank_bucket(h, p) - 1) - IF(netlens_rank_bucket(h, p) = 1, 0, shiftleft(1, netlens_rank_bucket(h, p) - 2))) + IF(netlens_rank_bucket(h, p) = 1, 0D, shiftleft(1, netlens_rank_bucket(h, p) - 2)) END"""),
}


def register(spark: SparkSession) -> SparkSession:
    """Makes the functions known to the session's SQL:

        SELECT class, netlens_percentile(netlens_counters(collect_list(struct(bucket, n))), 90)
        FROM (SELECT class, netlens_bucket(v) AS bucket, count(v) AS n FROM t GROUP BY ALL) GROUP BY class

    netlens_bucket(v) is the number of a value's bucket, netlens_counters(entries) the 14 counters as an array, netlens_merge(a, b)
    those of two states together, and netlens_percentile(h, p) the percentile that stat() tells. The inner GROUP BY leaves 14 rows of
    a class at most, so the list is short however many values there are. Stored states of many hours merge by their elements:
    posexplode(h), a sum for each position, and netlens_counters again.
    """
    for name, (arguments, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")
    return spark
