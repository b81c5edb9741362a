"""Column-level helpers built only from Spark built-ins (no Python UDFs)."""

from bridgelens.functions.json import json_kind, json_text, with_variant
from bridgelens.functions.labels import count_label, si_label, usd_label, with_display_names
from bridgelens.functions.numbers import safe_number, safe_product

__all__ = [
    "count_label", "json_kind", "json_text", "safe_number", "safe_product",
    "si_label", "usd_label", "with_display_names", "with_variant",
]
