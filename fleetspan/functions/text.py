"""Column expressions for keys, coercions and optional columns.

Everything here is a plain Spark SQL expression, so it stays inside
whole-stage codegen and can be pushed, folded and pruned by Catalyst.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The cell texts that tabular readers take for "missing".
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# White space of any kind, with the four ASCII separators.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
_NUMBER = r"(?i)^[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity)$"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Remove leading and trailing white space of any kind.

    Plain ``trim`` knows blanks only; a pattern would scan every text to its end.
    """
    return F.btrim(col(c), F.lit(WHITE_SPACE))


def normalize_key(c: Column | str, strip_domain: bool = False) -> Column:
    """Strip, upper-case, optionally cut at the first dot; empty text becomes null."""
    text = F.upper(strip(c))
    if strip_domain:
        text = F.substring_index(text, ".", 1)
    return F.nullif(text, F.lit(""))


def first_segment(c: Column | str) -> Column:
    """Text before the first comma, stripped; may be empty but not null for non-null input."""
    return strip(F.substring_index(col(c), ",", 1))


def to_double(c: Column | str) -> Column:
    """Number from text; anything that is not a plain number is null.

    ``try_cast`` alone would accept Java suffixes such as ``12d``.
    """
    text = strip(c)
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def numeric(df: DataFrame, name: str) -> Column:
    """A column as double: cast when it is a number, parsed when it is text."""
    kind = dict(df.dtypes)[name]
    return to_double(name) if kind == "string" else F.col(name).cast("double")


def to_date(c: Column | str, fmt: str = "yyyy-MM-dd") -> Column:
    """Date from text in one declared format, also with a time of midnight behind it; other texts are null."""
    text = strip(col(c).cast("string"))
    day = F.when(F.length(text) <= len("2000-01-01"), text).otherwise(F.regexp_replace(text, r"[ T]00:00:00(\.0+)?$", ""))
    return F.try_to_date(day, fmt)


def source_label(c: Column | str) -> Column:
    """Source tag with blanks and the text ``NAN`` repaired to ``NA``."""
    text = strip(c)
    return F.coalesce(F.nullif(F.nullif(text, F.lit("")), F.lit("NAN")), F.lit("NA"))


def not_in(c: Column | str, values: Iterable[str]) -> Column:
    """Row is kept unless its value is listed; null values are kept."""
    return ~F.coalesce(col(c).isin(*values), F.lit(False))


def null_tokens(df: DataFrame, tokens: Iterable[str] = NA_TOKENS) -> DataFrame:
    """Null out missing-value texts in every string column."""
    tokens = list(tokens)
    return df.select(
        *[
            F.when(~F.col(f"`{n}`").isin(tokens), F.col(f"`{n}`")).alias(n) if t == "string" else F.col(f"`{n}`")
            for n, t in df.dtypes
        ]
    )


def with_optional(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add the named columns as typed nulls where they are absent."""
    absent = {n: F.lit(None).cast(t) for n, t in columns.items() if n not in df.columns}
    return df.withColumns(absent) if absent else df


def require_columns(df: DataFrame, names: Iterable[str], what: str) -> None:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"{what} lacks required columns: {missing}")


def to_snake(label: str) -> str:
    """Column label in snake case; a label without letters or digits becomes ``col``."""
    return re.sub(r"[^0-9a-zA-Z]+", "_", str(label).strip().lower()).strip("_") or "col"


def snake_columns(df: DataFrame) -> DataFrame:
    """Rename all columns to snake case; two labels that collide are an error."""
    names = [to_snake(n) for n in df.columns]
    doubles = sorted({n for n in names if names.count(n) > 1})
    if doubles:
        raise ValueError(f"column labels collide after renaming: {doubles}")
    return df.toDF(*names)
