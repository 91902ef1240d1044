"""Vector arithmetic as column expressions, in double precision and fixed left-to-right order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def l2_squared(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def normalise(a: Column | str) -> Column:
    """Length 1; a vector of zeros stays as it is."""
    return F.element_at(
        F.transform(
            F.array(F.struct(doubles(a).alias("v"), norm(a).alias("n"))),
            lambda p: F.when(p["n"] == 0, p["v"]).otherwise(F.transform(p["v"], lambda x: x / p["n"])),
        ),
        1,
    )


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine in -1..1; 1 for two zero vectors, 0 where only one is zero."""
    na, nb = norm(a), norm(b)
    raw = dot(a, b) / (na * nb)
    return (
        F.when((na == 0) & (nb == 0), F.lit(1.0))
        .when((na == 0) | (nb == 0), F.lit(0.0))
        .otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw)))
    )


def sort_key(metric: str, a: Column | str, b: Column | str) -> Column:
    """Lower is closer for every metric: 1 - cosine, minus the dot product, or the squared distance."""
    if metric == "cosine":
        return F.lit(1.0) - cosine(a, b)
    if metric == "dot":
        return -dot(a, b)
    if metric == "euclidean":
        return l2_squared(a, b)
    raise ValueError(f"unknown metric: {metric}")


def maxsim(query: Column | str, document: Column | str) -> Column:
    """Sum over the query's vectors of the greatest dot product with a vector of the document."""
    q = (F.col(query) if isinstance(query, str) else query).cast("array<array<double>>")
    d = (F.col(document) if isinstance(document, str) else document).cast("array<array<double>>")
    best = F.transform(q, lambda x: F.array_max(F.transform(d, lambda y: dot(x, y))))
    return F.aggregate(best, F.lit(0.0), lambda s, x: s + x)


def sq8_code(v: Column | str) -> Column:
    """8-bit codes of a unit vector: round(clamp(127.5 v + 128, 0, 255))."""
    return F.transform(
        doubles(v), lambda x: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), x * 127.5 + 128.0)) + 0.5).cast("int")
    )


def sq8_query(v: Column | str) -> Column:
    """Signed query codes: round(clamp(127.5 v, -128, 127)), halves away from zero."""
    return F.transform(
        doubles(v), lambda x: F.round(F.greatest(F.lit(-128.0), F.least(F.lit(127.0), x * 127.5))).cast("int")
    )


def sq8_score(code: Column | str, query: Column | str) -> Column:
    """Integer score of codes against query codes; divided by 127.5 squared it is close to the cosine."""
    c, q = (F.col(x) if isinstance(x, str) else x for x in (code, query))
    return F.aggregate(F.zip_with(c, q, lambda x, y: (x - 128).cast("bigint") * y), F.lit(0).cast("bigint"), lambda s, x: s + x)
