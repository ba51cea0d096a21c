"""Column expressions; everything stays inside code generation."""

from __future__ import annotations


from pyspark.sql import Column, functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def safe_ratio(value, optimum) -> Column:
    """value / optimum; a zero optimum counts as reached only by a zero value."""
    v, o = _c(value), _c(optimum)
    return F.when(o == 0, F.when(v == 0, 1.0).otherwise(0.0)).otherwise(F.try_divide(v, o))


def run_id(entity, candidate, context, seed) -> Column:
    return F.concat_ws(
        "_", _c(entity).cast("string"), _c(candidate).cast("string"), _c(context).cast("string"),
        F.concat(F.lit("S"), _c(seed).cast("string")),
    )


def parse_vector(text) -> Column:
    """'(a, b]' -> array<double>; blank parts are dropped, blank text gives an empty array."""
    bare = F.regexp_replace(_c(text), r"[\s()\[\]]", "")
    parts = F.filter(F.split(bare, ","), lambda p: p != "")
    return F.transform(parts, lambda p: p.try_cast("double"))


def vector_halves(vector, half) -> tuple[Column, Column, Column]:
    """(first half, second half, is the length exactly two halves)."""
    v, d = _c(vector), _c(half)
    return F.slice(v, F.lit(1), d), F.slice(v, d + 1, d), F.size(v) == d * 2


def density(nodes, edges) -> Column:
    n, m = _c(nodes), _c(edges)
    return F.when(n <= 1, F.lit(0.0)).otherwise(F.try_divide(2.0 * m, n * (n - 1)))


def clip_upper(value, limit: float) -> Column:
    """Cap that keeps null (``least`` alone would return the limit)."""
    v = _c(value)
    return F.when(v.isNotNull(), F.least(v, F.lit(limit)))


def clip_lower(value, limit: float) -> Column:
    v = _c(value)
    return F.when(v.isNotNull(), F.greatest(v, F.lit(limit)))


def is_close(a, b, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    x, y = _c(a), _c(b)
    return F.abs(x - y) <= F.lit(atol) + F.lit(rtol) * F.abs(y)


def bit_label(bits, node, width) -> Column:
    """Label of a node in a little-endian bit string (the last character is node 0)."""
    return F.substring(_c(bits), _c(width) - _c(node), F.lit(1)).cast("int")


def mask_label(mask, node) -> Column:
    """The same label out of an integer mask; the node may be a column."""
    m, n = _c(mask), _c(node)
    return F.call_function("shiftright", m, n.cast("int")).bitwiseAND(F.lit(1).cast("bigint"))


def split_scope(scope, budget=None, context=None) -> tuple[Column, Column]:
    """'B256_N0' -> ('B256', 'N0'); explicit columns win over the label."""
    parts = F.split(_c(scope), "_")
    b = F.get(parts, F.lit(0))
    c = F.get(parts, F.lit(1))
    return (
        F.coalesce(_c(budget), b) if budget is not None else b,
        F.coalesce(_c(context), c) if context is not None else c,
    )


def is_cell_scope(scope, budgets, contexts) -> Column:
    """Does the label name one budget x context cell (not a margin)?"""
    pattern = "^(" + "|".join(budgets) + ")_(" + "|".join(contexts) + ")$"
    return _c(scope).rlike(pattern)


def category_code(column, ordered_values) -> Column:
    """Explicit value -> code map; unknown values stay null."""
    code = F.lit(None).cast("int")
    for i, v in reversed(list(enumerate(ordered_values))):
        code = F.when(_c(column) == F.lit(v), F.lit(i)).otherwise(code)
    return code


#: fixed values: a published Chebyshev fit of the complementary error function, relative error below 1.2e-7
ERFC_FIT = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587,
            -0.82215223, 0.17087277)


def two_sided_normal_p(z) -> Column:
    """erfc(|z| / sqrt 2), the p-value of a normal score on both sides, as a column expression."""
    x = F.abs(_c(z)) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + x / 2)
    fit = F.lit(0.0)
    for c in reversed(ERFC_FIT):
        fit = fit * t + c
    return F.least(F.lit(1.0), t * F.exp(fit - x * x))
