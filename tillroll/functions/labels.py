"""Classification expressions: private-label brands and household income bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillroll.sources.schema import INCOME_BANDS, PRIVATE_LABEL_BRAND


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_private_label(
    brand_col: str | Column,
    brand: str = PRIVATE_LABEL_BRAND,
    match: str = "equals",
    case_insensitive: bool = False,
) -> Column:
    """Private-label test on a brand column.

    ``match="equals"``: the brand equals ``brand``. ``match="regex"``: ``brand`` is an
    unanchored regular expression found anywhere in the brand (so it also hits longer
    codes that contain it). ``case_insensitive`` compares under the UTF8_LCASE collation.
    """
    c = _col(brand_col)
    if case_insensitive:
        c = F.collate(c, "UTF8_LCASE")
    if match == "equals":
        return c == F.lit(brand)
    if match == "regex":
        pattern = f"(?i){brand}" if case_insensitive else brand
        return _col(brand_col).rlike(pattern)
    raise ValueError("match must be 'equals' or 'regex'")


def income_band(income_col: str | Column, bands=INCOME_BANDS) -> Column:
    """Band label for an income code; NULL when the code is in no band (or NULL)."""
    c = _col(income_col)
    expr = None
    for label, lo, hi in bands:
        cond = (c >= lo) if hi is None else c.between(lo, hi)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr
