"""Column expressions: pure ``Column -> Column`` helpers, all JVM-side.

Each helper encodes one of the null / rounding / division rules the
pandas-based original relies on, so that callers cannot get them wrong:

* an equality flag on a missing value is 0, not NULL;
* ``x / 0`` is NULL (ANSI mode would raise);
* ``round`` is half-even like numpy (``bround``);
* a missing probability is classed as the highest risk.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import dims


def col_of(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def flag(cond: Column) -> Column:
    """0/1 flag as long; a NULL condition counts as 0 (pandas ``astype(int)``)."""
    return F.coalesce(cond.cast("long"), F.lit(0).cast("long"))


def equals_flag(c: str | Column, value) -> Column:
    return flag(col_of(c) == F.lit(value))


def safe_div(num: str | Column, den: str | Column) -> Column:
    """num / den with NULL for a zero or NULL denominator (never raises)."""
    return F.try_divide(col_of(num).cast("double"), col_of(den).cast("double"))


def nan_to_null(c: str | Column) -> Column:
    c = col_of(c)
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def half_even(c: str | Column, digits: int) -> Column:
    """numpy-style ``round``: half to even."""
    return F.bround(col_of(c), digits)


def logspace(start: float, stop: float, num: int) -> list[float]:
    """``num`` values from 10**start to 10**stop, evenly spaced in the exponent."""
    return [10.0 ** (start + (stop - start) * i / max(1, num - 1)) for i in range(num)]


def clip(c: str | Column, lower=None, upper=None) -> Column:
    """pandas ``clip``: NULL stays NULL (``greatest(NULL, 1)`` would be 1)."""
    c = col_of(c)
    out = c
    if lower is not None:
        out = F.greatest(out, F.lit(lower))
    if upper is not None:
        out = F.least(out, F.lit(upper))
    return F.when(c.isNull(), F.lit(None)).otherwise(out)


def classify_risk(p: str | Column) -> Column:
    """Bajo below 0.33, Medio below 0.66, Alto otherwise — NULL included."""
    p = col_of(p)
    return (F.when(p < F.lit(dims.RISK_LOW_BELOW), F.lit(dims.RISK_LOW))
            .when(p < F.lit(dims.RISK_MEDIUM_BELOW), F.lit(dims.RISK_MEDIUM))
            .otherwise(F.lit(dims.RISK_HIGH)))


def ordinal(c: str | Column, order: Sequence[str]) -> Column:
    """Position of the value in ``order`` (0-based); unknown -> NULL."""
    c = col_of(c)
    expr = None
    for i, value in enumerate(order):
        expr = (F.when(c == F.lit(value), F.lit(i)) if expr is None
                else expr.when(c == F.lit(value), F.lit(i)))
    return expr.otherwise(F.lit(None).cast("int")).cast("long")


def map_values(c: str | Column, mapping: Mapping, default=None) -> Column:
    """Dictionary lookup as an inline map literal (no join); miss -> default."""
    c = col_of(c)
    if not mapping:
        return F.lit(default)
    pairs = []
    for k, v in mapping.items():
        pairs += [F.lit(k), F.lit(v)]
    looked_up = F.try_element_at(F.create_map(*pairs), c)
    if default is None:
        return looked_up
    return F.coalesce(looked_up, F.lit(default))


def target_label(c: str | Column, labels: Mapping[int, str] | None = None) -> Column:
    labels = labels or dims.TARGET_LABELS
    c = col_of(c)
    expr = None
    for k, v in labels.items():
        expr = (F.when(c == F.lit(k), F.lit(v)) if expr is None
                else expr.when(c == F.lit(k), F.lit(v)))
    return expr


def clean_feature_name(c: str | Column,
                       prefixes: Sequence[str] = tuple(dims.FEATURE_NAME_PREFIXES)) -> Column:
    """Drop encoder prefixes and turn underscores into spaces."""
    out = col_of(c).cast("string")
    for p in prefixes:
        out = F.replace(out, F.lit(p), F.lit(""))
    return F.replace(out, F.lit("_"), F.lit(" "))


def _two_product(a: Column, b: float) -> tuple[Column, Column]:
    """Error-free product: ``a * b == p + err`` exactly (Dekker / Veltkamp)."""
    def split(x):
        c = F.lit(134217729.0) * x
        hi = c - (c - x)
        return hi, x - hi
    p = a * F.lit(b)
    ah, al = split(a)
    bh, bl = split(F.lit(b))
    err = ((ah * bh - p) + ah * bl + al * bh) + al * bl
    return p, err


def format_fixed(c: str | Column, digits: int = 2) -> Column:
    """Python ``format(x, '.2f')``: rounds the *exact* binary value half to
    even (0.595 -> '0.59').  Java's ``%.2f`` rounds the shortest decimal text
    half up ('0.60'), so the scaled value is split into an exact sum
    ``p + err`` and ties of ``p`` are settled by the sign of ``err``."""
    x = col_of(c).cast("double")
    p, err = _two_product(x, float(10 ** digits))
    fl = F.floor(p)
    frac = p - fl
    up = (F.when(frac > 0.5, True).when(frac < 0.5, False)
           .when(err > 0, True).when(err < 0, False)
           .otherwise(fl % 2 != 0))
    n = (fl + F.when(up, 1).otherwise(0)).cast("decimal(38,0)")
    text = (n / F.lit(10 ** digits)).cast(f"decimal(38,{digits})").cast("string")
    return F.when(x.isNull(), F.lit(None).cast("string")).otherwise(text)


def format_percent(c: str | Column, digits: int = 2) -> Column:
    """Python ``format(x, '.2%')``: x * 100 in double arithmetic, then exact
    fixed formatting and a percent sign."""
    return F.concat(format_fixed(col_of(c).cast("double") * F.lit(100.0), digits), F.lit("%"))


def parse_int_tuple(c: str | Column) -> Column:
    """'(128, 64)' / '[32]' / '64' -> array<int>."""
    return F.transform(F.regexp_extract_all(col_of(c), F.lit(r"(-?\d+)"), 1),
                       lambda x: x.cast("int"))


def none_text_to_null(c: str | Column) -> Column:
    """'none' / 'nan' / '' (any case, trimmed) -> NULL."""
    c = col_of(c)
    t = F.lower(F.trim(c.cast("string")))
    return F.when(t.isin("none", "nan", "null", ""), F.lit(None)).otherwise(c)
