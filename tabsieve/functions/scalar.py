"""Scalar column functions (all JVM-side expressions, no Python UDFs).

Each returns a ``Column``; callers pass column names or Columns.
"""

from __future__ import annotations

from functools import reduce
from typing import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

ColumnOrName = Column | str

# Parsecs to light years (must equal the reference's factor).
PC_TO_LY = 3.26156
# Artefact timestamp pattern yyyyMMdd_HHmmss.
STAMP_PATTERN = r"(\d{8}_\d{6})"


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- rounding
def round_half_up(c: ColumnOrName, digits: int = 2) -> Column:
    """``floor(x*10^d + 0.5) / 10^d`` in double arithmetic.

    Engines disagree on ``round`` at binary ties (1.005); this form gives the
    same bits in Spark and in any SQL engine with IEEE doubles.
    """
    s = float(10 ** digits)
    return (F.floor(_c(c) * F.lit(s) + F.lit(0.5)) / F.lit(s)).cast("double")


def pct(num: ColumnOrName, den: ColumnOrName, digits: int = 2) -> Column:
    """Rounded percentage with a zero-divide guard (A5): 0 when den is 0."""
    return F.when(_c(den) > 0, round_half_up(_c(num) * F.lit(100.0) / _c(den), digits)).otherwise(F.lit(0.0))


def fmt_fixed(c: ColumnOrName, digits: int = 2) -> Column:
    """Fixed-point text (``%.2f``) of a half-up rounded value."""
    return F.format_string(f"%.{digits}f", round_half_up(c, digits))


# ---------------------------------------------------------------- names
def first_token(c: ColumnOrName) -> Column:
    """First whitespace-delimited token of a name; blank or null -> null.

    'Supplier#000000007 2' -> 'Supplier#000000007'. An optional '-suffix' part of the token is
    already included because a token never contains whitespace.
    """
    return F.nullif(F.regexp_extract(F.trim(_c(c)), r"^\s*(\S+)", 1), F.lit(""))


def stamp_of(path: ColumnOrName) -> Column:
    """The ``yyyyMMdd_HHmmss`` stamp inside a file name, or null."""
    return F.nullif(F.regexp_extract(_c(path), STAMP_PATTERN, 1), F.lit(""))


# ---------------------------------------------------------------- geometry
def sph_to_cart(ra_deg: ColumnOrName, dec_deg: ColumnOrName, dist: ColumnOrName) -> Column:
    """struct(x, y, z) from right ascension / declination in degrees and a
    distance; a null distance gives null coordinates."""
    ra, dec, d = F.radians(_c(ra_deg)), F.radians(_c(dec_deg)), _c(dist)
    ok = d.isNotNull()
    return F.struct(
        F.when(ok, d * F.cos(dec) * F.cos(ra)).alias("x"),
        F.when(ok, d * F.cos(dec) * F.sin(ra)).alias("y"),
        F.when(ok, d * F.sin(dec)).alias("z"),
    )


def pc_to_ly(c: ColumnOrName) -> Column:
    """Parsecs to light years."""
    return _c(c) * F.lit(PC_TO_LY)


def prefer_when_present(present: ColumnOrName, preferred: ColumnOrName, fallback: ColumnOrName) -> Column:
    """``preferred`` when ``present`` is non-null, else ``fallback``.

    Not ``coalesce``: the preferred value itself may be null and is kept so.
    """
    return F.when(_c(present).isNotNull(), _c(preferred)).otherwise(_c(fallback))


# ---------------------------------------------------------------- categories
def categorize(c: ColumnOrName, rules: Sequence[tuple[str, bool | None, str]],
               default: str = "UNKNOWN") -> Column:
    """Ordered substring rules on the upper-cased text.

    ``rules`` = [(needle, flag, category), ...]; the first rule whose needle is
    contained wins. Returns struct(flag boolean, category string); null or
    unmatched input gives (null, default).
    """
    u = F.upper(_c(c).cast("string"))
    flag = F.lit(None).cast("boolean")
    cat = F.lit(default)
    for needle, fl, name in reversed(list(rules)):
        hit = u.contains(needle.upper())
        flag = F.when(hit, F.lit(fl).cast("boolean")).otherwise(flag)
        cat = F.when(hit, F.lit(name)).otherwise(cat)
    flag = F.when(u.isNull(), F.lit(None).cast("boolean")).otherwise(flag)
    cat = F.when(u.isNull(), F.lit(default)).otherwise(cat)
    return F.struct(flag.alias("flag"), cat.alias("category"))


def category_flag(c: ColumnOrName, true_values: Iterable[str], false_values: Iterable[str]) -> Column:
    """Category -> nullable boolean (true / false / unknown)."""
    col = _c(c)
    return (F.when(col.isin(list(true_values)), F.lit(True))
             .when(col.isin(list(false_values)), F.lit(False))
             .otherwise(F.lit(None).cast("boolean")))


def canonical_label(c: ColumnOrName) -> Column:
    """Quirk 1: labels compared in one spelling (upper case, '_' for spaces)."""
    return F.regexp_replace(F.upper(F.trim(_c(c))), r"\s+", "_")


def normalise_param(value: str | None) -> str | None:
    """F1 parameter normalisation (upper, '_' -> space), driver-side."""
    return None if value is None else value.upper().replace("_", " ")


# ---------------------------------------------------------------- numbers
def nan_to_null(c: ColumnOrName) -> Column:
    """K9: NaN -> null for a floating column."""
    col = _c(c)
    return F.when(~F.isnan(col), col)


def nan_to_null_all(df):
    """K9 over every float/double column of a DataFrame."""
    return df.withColumns({f.name: nan_to_null(f.name) for f in df.schema.fields
                           if f.dataType.typeName() in ("double", "float")})


def fill_value(c: ColumnOrName, value) -> Column:
    """Constant (or median, passed as a literal/Column) fill."""
    v = value if isinstance(value, Column) else F.lit(value)
    return F.coalesce(_c(c), v)


def standardise(c: ColumnOrName, mean: ColumnOrName, std: ColumnOrName) -> Column:
    """(x - mean) / std, with std 0 (or null) treated as 1."""
    s = _c(std)
    return (_c(c) - _c(mean)) / F.when(s.isNull() | (s == 0), F.lit(1.0)).otherwise(s)


def row_max(cols: Sequence[ColumnOrName]) -> Column:
    """Row maximum over columns (confidence)."""
    return F.greatest(*[_c(x) for x in cols]) if len(cols) > 1 else _c(cols[0])


def truncate_text(c: ColumnOrName, n: int = 500, marker: str = "...") -> Column:
    """X11: first n characters plus marker when longer."""
    col = _c(c)
    return F.when(F.length(col) > n, F.concat(F.substring(col, 1, n), F.lit(marker))).otherwise(col)


def kilobytes(c: ColumnOrName) -> Column:
    """Bytes to KB."""
    return _c(c) / F.lit(1024.0)


def megabytes(c: ColumnOrName) -> Column:
    """Bytes to MB."""
    return _c(c) / F.lit(1024.0 * 1024.0)


def now_stamp() -> Column:
    """Current time as yyyyMMdd_HHmmss."""
    return F.date_format(F.current_timestamp(), "yyyyMMdd_HHmmss")


def all_not_null(cols: Sequence[ColumnOrName]) -> Column:
    """every listed column non-null."""
    return reduce(lambda a, b: a & b, [_c(x).isNotNull() for x in cols])
