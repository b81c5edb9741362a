"""Display labels as columns (thousands separators, SI short form).

These only format numbers the reports already computed; they never feed back
into a measure.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bridgelens.config import DISPLAY_NAMES, SI_PREFIXES


def usd_label(x: Column) -> Column:
    """``$1,234,567`` (whole dollars); NULL stays NULL."""
    return F.concat(F.lit("$"), F.format_number(x, 0))


def count_label(n: Column, unit: str | None = None) -> Column:
    """``5,525`` or ``5,525 Txns`` when a unit word is given."""
    text = F.format_number(n, 0)
    return F.concat(text, F.lit(" " + unit)) if unit else text


def si_label(x: Column) -> Column:
    """Two significant digits with an SI prefix, e.g. ``32G``, ``1.2k``, ``0.0``.

    Same result as the d3 format ``.2s``: the value is first rounded to two
    significant digits, the prefix is chosen from the rounded value, and the
    mantissa keeps as many decimals as the two digits need.  Negative values
    get d3's minus sign (U+2212).
    """
    ax = F.abs(x)
    e0 = F.floor(F.log10(ax))
    step = F.pow(F.lit(10.0), e0 - 1)
    rounded = F.round(ax / step) * step
    e = F.floor(F.log10(F.abs(rounded)))
    i = F.least(F.greatest(F.floor(e / 3), F.lit(-8)), F.lit(8))
    mant = rounded / F.pow(F.lit(10.0), i * 3)
    # two significant digits: one decimal when the mantissa has one integer digit
    text = F.when(e - i * 3 == 0, F.format_string("%.1f", mant)).otherwise(
        F.format_string("%.0f", mant)
    )
    prefix = F.element_at(F.array(*[F.lit(p) for p in SI_PREFIXES]), (i + 9).cast("int"))
    body = F.concat(F.when(x < 0, F.lit("\u2212")).otherwise(F.lit("")), text, prefix)
    return F.when(x.isNull(), F.lit(None).cast("string")).when(x == 0, F.lit("0.0")).otherwise(body)


def with_display_names(df):
    """Rename report columns to the dashboard's display names (edge only)."""
    return df.withColumnsRenamed({c: DISPLAY_NAMES[c] for c in df.columns if c in DISPLAY_NAMES})
