"""Relational operators the reports are composed from."""

from bridgelens.operators.buckets import bucket, check_unit
from bridgelens.operators.extract import gmp_events, transfer_events, union_services
from bridgelens.operators.filters import completed, date_between, in_date_range, router_match
from bridgelens.operators.quantile import exact_median, exact_median_by
from bridgelens.operators.topk import top_k
from bridgelens.operators.windows import running_sum

__all__ = [
    "bucket", "check_unit", "completed", "date_between", "exact_median", "exact_median_by", "gmp_events",
    "in_date_range", "router_match", "running_sum", "top_k", "transfer_events",
    "union_services",
]
