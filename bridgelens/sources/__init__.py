"""Sources: fact-table readers and the fixture derivation from test data."""

from bridgelens.sources.fixtures import TEST_ROUTERS, fixture_gmp, fixture_transfers, gmp_from, transfers_from
from bridgelens.sources.tables import read_facts, read_gmp, read_table, read_transfers, store_variant

__all__ = [
    "TEST_ROUTERS", "fixture_gmp", "fixture_transfers", "gmp_from", "read_facts", "read_gmp",
    "read_table", "read_transfers", "store_variant", "transfers_from",
]
