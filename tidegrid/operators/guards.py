"""Input checks shared by all operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require_columns(df: DataFrame, names: Iterable[str], what: str = "input") -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"{what} is missing columns: {', '.join(missing)}")
    return df


def hash32(*parts: Column | str) -> Column:
    """Number from 0 to 2**32 - 1 that depends on the parts only, the same in every engine that has MD5.

    The parts' texts are joined by ``|``; a null part is an empty text.
    """
    texts = [F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *texts)), 1, 8), 16, 10).cast("bigint")


def clean_double(col: Column) -> Column:
    """Number or NULL: text that is no number, and NaN, both become NULL."""
    return F.nanvl(col.try_cast("double"), F.lit(None).cast("double"))


def ratio(num: Column, den: Column) -> Column:
    """Division that gives NULL for a zero denominator."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def r6(col: Column, digits: int = 6) -> Column:
    """Rounded double for comparable results: ties are pushed outwards, negative zero is avoided."""
    value = col.cast("double")
    return F.round(value + F.signum(value) * F.lit(10.0 ** -(digits + 3)), digits) + F.lit(0.0)


def rounded(df: DataFrame, names: Iterable[str], digits: int = 6) -> DataFrame:
    """``r6`` on several columns, written as SQL text (one call per column)."""
    names = list(names)
    nudge = f"1e-{digits + 3}D"
    text = "round(cast(`{c}` as double) + signum(cast(`{c}` as double)) * {nudge}, {digits}) + 0.0D"
    return df.withColumns({c: F.expr(text.format(c=c, nudge=nudge, digits=digits)) for c in names})


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation over the rows where both are present; NULL when one of them does not vary."""
    both = x.isNotNull() & y.isNotNull()
    spread = F.sqrt(F.var_pop(F.when(both, x))) * F.sqrt(F.var_pop(F.when(both, y)))
    return F.try_divide(F.covar_pop(x, y), spread)


def flag(cond: Column) -> Column:
    """Boolean as 0/1, NULL counts as 0."""
    return F.coalesce(cond, F.lit(False)).cast("int")
