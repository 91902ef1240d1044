"""SQL names for the functions of the library."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tarnwell.functions.text import PLAIN, PRESETS

_DOT = "aggregate(zip_with({a}, {b}, (x, y) -> x * y), 0D, (s, x) -> s + x)"
_BEST = f"transform(q, u -> array_max(transform(d, v -> {_DOT.format(a='u', b='v')})))"
_SQUARES = "aggregate({a}, 0D, (s, x) -> s + x * x)"
_NORMS = f"sqrt({_SQUARES.format(a='a')}) * sqrt({_SQUARES.format(a='b')})"

#: Functions whose body is an expression, so that they stay inside generated code: parameters, result, body.
EXPRESSIONS = {
    "tw_cosine": (
        "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE",
        f"CASE WHEN {_NORMS} > 0 THEN greatest(-1D, least(1D, {_DOT.format(a='a', b='b')} / ({_NORMS}))) "
        f"WHEN {_SQUARES.format(a='a')} = {_SQUARES.format(a='b')} THEN 1D WHEN a IS NOT NULL AND b IS NOT NULL THEN 0D END",
    ),
    "tw_maxsim": (
        "q ARRAY<ARRAY<DOUBLE>>, d ARRAY<ARRAY<DOUBLE>>", "DOUBLE",
        f"CASE WHEN size(q) > 0 AND size(d) > 0 THEN aggregate({_BEST}, 0D, (s, x) -> s + x) END",
    ),
    "tw_analyze_plain": ("t STRING", "ARRAY<STRING>", r"transform(regexp_extract_all(coalesce(t, ''), '[\\p{L}\\p{N}]+', 0), w -> lower(w))"),
}


def register(spark: SparkSession) -> list[str]:
    """Register ``tw_cosine``, ``tw_maxsim`` and ``tw_analyze_<preset>`` for SQL: expressions where one can say it, Arrow
    batches for analyzers that fold or stem."""
    names = list(EXPRESSIONS)
    for name, (parameters, result, body) in EXPRESSIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    for name, analyzer in PRESETS.items():
        if analyzer != PLAIN:
            names.append(f"tw_analyze_{name}")
            spark.udf.register(names[-1], _analyzer(analyzer))
    return sorted(names)


def _analyzer(analyzer):
    return F.pandas_udf(lambda s: s.map(analyzer.terms), "array<string>")
