"""Fixed values and defaults used across the package.

Everything a report depends on that is not read from data lives here, so a
dialect decision or a changed contract list is a one-line edit.
"""

from __future__ import annotations

from datetime import date

# --- Fixed values -------------------------------------------------------------
# These must equal the dashboard's own values for identical results.

# Router contracts whose traffic is counted (case-insensitive containment).
DEFAULT_ROUTERS: tuple[str, ...] = (
    "0xce16F69375520ab01377ce7B88f5BA8C48F8D666",
    "0x492751eC3c57141deb205eC2da8bFcb410738630",
    "0xDC3D8e1Abe590BCa428a8a2FC4CfDbD1AcF57Bd9",
    "0xdf4fFDa22270c12d0b5b3788F1669D709476111E",
    "0xe6B3949F9bBF168f4E3EFc82bc8FD849868CC6d8",
)

# Record states that count as a completed bridge.
STATUS_DONE = "executed"
SIMPLIFIED_STATUS_DONE = "received"

# Service tags written into the unified relation.
SERVICE_TRANSFERS = "Token Transfers"
SERVICE_GMP = "GMP"
SERVICES: tuple[str, ...] = (SERVICE_TRANSFERS, SERVICE_GMP)

# Time-series bucket units offered by the dashboard.
TIME_UNITS: tuple[str, ...] = ("month", "week", "day")

# Widget defaults of the dashboard.
DEFAULT_UNIT = "month"
DEFAULT_START = date(2024, 1, 1)
DEFAULT_END = date(2025, 8, 31)

# Paths inside the semi-structured `data` column (keys are case-sensitive).
T_SOURCE_CHAIN = "$.send.original_source_chain"
T_DESTINATION_CHAIN = "$.send.original_destination_chain"
T_AMOUNT = "$.send.amount"
T_PRICE = "$.link.price"
T_FEE = "$.send.fee_value"
T_ASSET = "$.link.asset"
G_SOURCE_CHAIN = "$.call.chain"
G_DESTINATION_CHAIN = "$.call.returnValues.destinationChain"
G_USER = "$.call.transaction.from"
G_AMOUNT = "$.amount"
G_VALUE = "$.value"
G_GAS_USED = "$.gas.gas_used_amount"
G_GAS_USD = "$.gas_price_rate.source_token.token_price.usd"
G_EXPRESS_FEE = "$.fees.express_fee_usd"
G_SYMBOL = "$.symbol"
G_CONTRACT = "$.approved.returnValues.contractAddress"

TRANSFER_PATHS: tuple[str, ...] = (
    T_SOURCE_CHAIN, T_DESTINATION_CHAIN, T_AMOUNT, T_PRICE, T_FEE, T_ASSET,
)
GMP_PATHS: tuple[str, ...] = (
    G_SOURCE_CHAIN, G_DESTINATION_CHAIN, G_USER, G_AMOUNT, G_VALUE, G_GAS_USED,
    G_GAS_USD, G_EXPRESS_FEE, G_SYMBOL, G_CONTRACT,
)

# Column headers shown by the dashboard, keyed by our snake_case names.
DISPLAY_NAMES: dict[str, str] = {
    "source_chain": "Source Chain",
    "destination_chain": "Destination Chain",
    "number_of_transfers": "Number of Transfers",
    "number_of_users": "Number of Users",
    "volume_usd": "Volume of Transfers (USD)",
}

# --- Our decisions (the warehouse dialect is not visible) ---------------------

# Dollar labels show whole dollars ('$1,234,567'), also for figures that the
# page prints with a decimal; rounded measures have none to show.  A product
# of two guarded numbers that overflows is NULL.  Days are UTC days.

# Short-label prefixes for 1e-24 .. 1e24 in steps of 1e3 (SI, as in d3 ".2s").
SI_PREFIXES: tuple[str, ...] = (
    "y", "z", "a", "f", "p", "n", "µ", "m", "", "k", "M", "G", "T", "P", "E", "Z", "Y",
)

# Text accepted as a number: plain decimal / scientific notation only.  Rejects
# '1d', 'inf', 'NaN', hex and digit separators, which some engines would cast.
NUMBER_PATTERN = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"

# Unified relation, in column order.
EVENT_COLUMNS: tuple[str, ...] = (
    "created_at", "source_chain", "destination_chain", "user", "amount",
    "amount_usd", "fee", "id", "service", "raw_asset",
)
# Day of an event (a plain column of the saved relation, sorted within files).
EVENT_DATE = "event_date"
# Partition column of the saved relation: first day of the event's month.
EVENT_MONTH = "event_month"
