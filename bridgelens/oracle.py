"""Independent DuckDB SQL for every registered query (the correctness oracle).

Each statement derives the two fact tables from the pre-registered test views
(``lineitem``, ``orders``) with the same rules as ``sources.fixtures`` and then
computes the report in plain SQL, so the Spark plans are checked against a
second engine.  Only SQL text lives here.
"""

from __future__ import annotations

from bridgelens.sources.fixtures import TEST_ROUTERS

# Literals of its own: a wrong constant of the library must not pass both sides.
TRANSFERS, GMP = "Token Transfers", "GMP"
NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
G_AMOUNT = "$.amount"
G_CONTRACT = "$.approved.returnValues.contractAddress"
G_DESTINATION_CHAIN = "$.call.returnValues.destinationChain"
G_EXPRESS_FEE = "$.fees.express_fee_usd"
G_GAS_USD = "$.gas_price_rate.source_token.token_price.usd"
G_GAS_USED = "$.gas.gas_used_amount"
G_SOURCE_CHAIN = "$.call.chain"
G_SYMBOL = "$.symbol"
G_USER = "$.call.transaction.from"
G_VALUE = "$.value"
T_AMOUNT = "$.send.amount"
T_ASSET = "$.link.asset"
T_DESTINATION_CHAIN = "$.send.original_destination_chain"
T_FEE = "$.send.fee_value"
T_PRICE = "$.link.price"
T_SOURCE_CHAIN = "$.send.original_source_chain"

RANGE = ("1996-03-01", "1999-08-31")

_R1, _R2, _R3 = TEST_ROUTERS[0], TEST_ROUTERS[1], TEST_ROUTERS[2]


def _v(x: str) -> str:
    return f"CAST({x} AS VARCHAR)"


FACTS = f"""
transfers AS (
  SELECT l_orderkey AS id, l_shipdate AS created_at,
    'u' || {_v('l_suppkey')} AS recipient_address,
    CASE l_suppkey % 4 WHEN 0 THEN '{"0x" + _R1[2:].upper()}' WHEN 1 THEN 'pre{_R2}post'
      WHEN 2 THEN '0xffff' END AS sender_address,
    CASE WHEN l_linestatus = 'F' THEN 'executed' ELSE 'pending' END AS status,
    CASE WHEN l_returnflag = 'N' THEN 'failed' ELSE 'received' END AS simplified_status,
    '{{"send":{{"original_source_chain":"Nation_' || {_v('l_suppkey % 25')}
      || '","original_destination_chain":"NATION_' || {_v('l_partkey % 25')}
      || '","amount":' || CASE l_orderkey % 11 WHEN 0 THEN '[1,2]' WHEN 1 THEN '{{"x":1}}'
           WHEN 2 THEN 'null' WHEN 3 THEN 'true' WHEN 4 THEN '"abc"'
           WHEN 5 THEN '"' || {_v('CAST(l_quantity AS BIGINT)')} || '"'
           ELSE {_v('CAST(l_quantity AS BIGINT)')} END
      || ',"fee_value":' || CASE WHEN l_linenumber = 1 THEN '[]' ELSE {_v('l_linenumber')} END
      || '}},"link":{{"price":' || CASE WHEN l_partkey % 13 = 0 THEN '[]'
           ELSE {_v('CAST(round(l_extendedprice * 100) AS BIGINT)')} END
      || ',"asset":"a' || {_v('l_partkey % 7')} || '"}}}}' AS data
  FROM lineitem
),
gmp AS (
  SELECT o_orderkey AS id, o_orderdate AS created_at,
    CASE WHEN o_orderstatus = 'O' THEN 'pending' ELSE 'executed' END AS status,
    'received' AS simplified_status,
    '{{"call":{{"chain":"Nation_' || {_v('o_custkey % 25')}
      || '","returnValues":{{"destinationChain":"nation_' || {_v('o_orderkey % 25')}
      || '"}},"transaction":{{"from":"u' || {_v('o_custkey')}
      || '"}}}},"value":' || CASE o_orderkey % 9 WHEN 0 THEN '[]' WHEN 1 THEN '"n/a"'
           WHEN 2 THEN 'false' ELSE {_v('CAST(round(o_totalprice * 100) AS BIGINT)')} END
      || ',"amount":' || {_v('o_custkey')}
      || ',"symbol":"s' || {_v('o_custkey % 5')}
      || '","gas":{{"gas_used_amount":' || CASE o_orderkey % 5 WHEN 0 THEN '{{}}' WHEN 1 THEN '"x"'
           ELSE {_v('o_custkey')} END
      || '}},"gas_price_rate":{{"source_token":{{"token_price":{{"usd":'
      || CASE WHEN o_orderkey % 7 = 0 THEN '[]' ELSE '3' END
      || '}}}}}},"fees":{{"express_fee_usd":' || CASE WHEN o_orderkey % 3 = 0 THEN 'null'
           ELSE {_v('o_orderkey % 100')} END
      || '}},"approved":{{"returnValues":{{"contractAddress":"'
      || CASE WHEN o_custkey % 3 = 0 THEN '{_R3.upper()}' ELSE '0xdead' END || '"}}}}}}' AS data
  FROM orders
)"""


def _txt(path: str, col: str = "data") -> str:
    return f"json_extract_string({col}, '{path}')"


def _num(path: str) -> str:
    s = _txt(path)
    cast = f"TRY_CAST({s} AS DOUBLE)"
    return (f"(CASE WHEN regexp_matches({s}, '{NUMBER}') AND abs({cast}) < 'inf'::DOUBLE "
            f"THEN {cast} END)")


def _product(a: str, b: str) -> str:
    """A product that is NULL where it overflows."""
    x = f"({_num(a)} * {_num(b)})"
    return f"(CASE WHEN abs({x}) < 'inf'::DOUBLE THEN {x} END)"


def _routers(col: str) -> str:
    return "(" + " OR ".join(f"lower({col}) LIKE '%{r.lower()}%'" for r in TEST_ROUTERS) + ")"


def _day_range(col: str = "created_at", rng: tuple[str, str] = RANGE) -> str:
    return f"CAST({col} AS DATE) BETWEEN DATE '{rng[0]}' AND DATE '{rng[1]}'"


def _te(source: str = "transfers", extra: str = "") -> str:
    extra = f" AND {extra}" if extra else ""
    return f"""
te AS (
  SELECT created_at,
    lower({_txt(T_SOURCE_CHAIN)}) AS source_chain,
    lower({_txt(T_DESTINATION_CHAIN)}) AS destination_chain,
    recipient_address AS "user",
    {_num(T_AMOUNT)} AS amount,
    {_product(T_AMOUNT, T_PRICE)} AS amount_usd,
    {_num(T_FEE)} AS fee,
    id, '{TRANSFERS}' AS service,
    {_txt(T_ASSET)} AS raw_asset
  FROM {source}
  WHERE status = 'executed' AND simplified_status = 'received' AND {_routers('sender_address')}{extra}
)"""


def _ge(extra: str = "") -> str:
    extra = f" AND {extra}" if extra else ""
    return f"""
ge AS (
  SELECT created_at,
    {_txt(G_SOURCE_CHAIN)} AS source_chain,
    {_txt(G_DESTINATION_CHAIN)} AS destination_chain,
    {_txt(G_USER)} AS "user",
    {_num(G_AMOUNT)} AS amount,
    {_num(G_VALUE)} AS amount_usd,
    coalesce({_product(G_GAS_USED, G_GAS_USD)}, {_num(G_EXPRESS_FEE)}) AS fee,
    id, '{GMP}' AS service,
    {_txt(G_SYMBOL)} AS raw_asset
  FROM gmp
  WHERE status = 'executed' AND simplified_status = 'received'
    AND {_routers(_txt(G_CONTRACT))}{extra}
)"""


def _branches(where_extra: str = "") -> str:
    return ",".join([_te("transfers", where_extra), _ge(where_extra),
                     "\nev AS (SELECT * FROM te UNION ALL SELECT * FROM ge)"])


# Transfers with real times of day, derived from the events table.
EVENT_RANGE = ("2024-01-01", "2024-01-30")
EVENT_FACTS = f"""
et AS (
  SELECT event_id AS id, ts AS created_at,
    'u' || {_v('user_id')} AS recipient_address,
    CASE WHEN event_type = 'error' THEN '0xffff' ELSE '{TEST_ROUTERS[1].upper()}' END AS sender_address,
    'executed' AS status, 'received' AS simplified_status,
    '{{"send":{{"original_source_chain":"' || event_type
      || '","original_destination_chain":"Chain_' || {_v('user_id % 7')}
      || '","amount":' || {_v("CAST(json_extract_string(props, '$.k') AS BIGINT)")}
      || ',"fee_value":1}},"link":{{"price":' || {_v('CAST(round(value * 100) AS BIGINT)')}
      || ',"asset":"e"}}}}' AS data
  FROM events
)"""


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join([FACTS, *ctes]) + "\n"


EVENTS = _branches()
EVENTS_RANGED = _branches(_day_range())
EV_COLS = 'created_at, source_chain, destination_chain, "user", amount, amount_usd, fee, id, service, raw_asset'


def _time_series(unit: str, ctes: tuple[str, ...] | None = None, table: str = "ev",
                 rng: tuple[str, str] = RANGE) -> str:
    bucket = "CAST(created_at AS DATE)" if unit == "day" else f"CAST(date_trunc('{unit}', created_at) AS DATE)"
    return _with(*(ctes or (EVENTS,)), f"""b AS (
  SELECT {bucket} AS date,
    count(DISTINCT id) AS number_of_bridges,
    count(DISTINCT "user") AS number_of_bridgers,
    round(sum(amount_usd)) AS bridged_volume,
    avg(amount_usd) AS avg_bridged_volume
  FROM {table} WHERE {_day_range(rng=rng)} GROUP BY 1
)""") + """SELECT date, number_of_bridges, number_of_bridgers, bridged_volume,
  sum(bridged_volume) OVER (ORDER BY date) AS total_bridged_volume,
  CAST(sum(number_of_bridges) OVER (ORDER BY date) AS BIGINT) AS total_number_of_bridges,
  round(number_of_bridges / nullif(number_of_bridgers, 0), 1) AS avg_bridge_count_per_user,
  avg_bridged_volume
FROM b ORDER BY date"""


def _kpi_select(table: str = "ev", rng: tuple[str, str] = RANGE) -> str:
    return f"""SELECT count(DISTINCT id) AS number_of_transfers,
  count(DISTINCT "user") AS number_of_users,
  round(sum(amount_usd)) AS volume_of_transfers,
  round(median(amount_usd)) AS median_bridged_volume,
  round(max(amount_usd)) AS maximum_bridged_volume,
  round(avg(amount_usd)) AS average_bridged_volume
FROM {table} WHERE {_day_range(rng=rng)}"""


def _chain(chain: str) -> str:
    return _with(EVENTS, f"""r AS (
  SELECT {chain}, count(DISTINCT id) AS number_of_transfers,
    count(DISTINCT "user") AS number_of_users, round(sum(amount_usd)) AS volume_usd
  FROM ev GROUP BY 1
)""")


def _chain_ranged(chain: str) -> str:
    return _with(EVENTS_RANGED) + (
        f"SELECT {chain}, count(DISTINCT id) AS number_of_transfers, "
        f'count(DISTINCT "user") AS number_of_users, round(sum(amount_usd)) AS volume_usd FROM ev GROUP BY 1')


def _top(chain: str, by: str) -> str:
    if by == "volume":
        order = f"volume_usd DESC NULLS LAST, number_of_transfers DESC, {chain} ASC NULLS FIRST"
    else:
        order = f"number_of_transfers DESC, volume_usd DESC NULLS LAST, {chain} ASC NULLS FIRST"
    return _chain(chain) + f"SELECT * FROM r ORDER BY {order} LIMIT 10"


def _usd(x: str) -> str:
    return f"('$' || format('{{:,.0f}}', {x}))"


def _count(x: str, unit: str | None = None) -> str:
    t = f"format('{{:,}}', {x})"
    return f"({t} || ' {unit}')" if unit else t


def _si(x: str) -> str:
    prefixes = "['y', 'z', 'a', 'f', 'p', 'n', 'µ', 'm', '', 'k', 'M', 'G', 'T', 'P', 'E', 'Z', 'Y']"
    r = f"(round(abs({x}) / pow(10.0, floor(log10(abs({x}))) - 1)) * pow(10.0, floor(log10(abs({x}))) - 1))"
    e = f"floor(log10(abs({r})))"
    i = f"least(greatest(floor({e} / 3), -8), 8)"
    mant = f"({r} / pow(10.0, {i} * 3))"
    text = f"(CASE WHEN {e} - {i} * 3 = 0 THEN printf('%.1f', {mant}) ELSE printf('%.0f', {mant}) END)"
    return (f"(CASE WHEN {x} IS NULL THEN NULL WHEN {x} = 0 THEN '0.0' "
            f"ELSE (CASE WHEN {x} < 0 THEN '\u2212' ELSE '' END) || {text} || {prefixes}[CAST({i} AS INTEGER) + 9] END)")


def _kind(path: str) -> str:
    t = f"json_type(data, '{path}')"
    return (f"(CASE WHEN {t} IS NULL THEN NULL WHEN {t} = 'ARRAY' THEN 'array' "
            f"WHEN {t} = 'OBJECT' THEN 'object' WHEN {t} = 'NULL' THEN 'null' ELSE 'scalar' END)")


def _json_long() -> str:
    t = " UNION ALL ".join(
        f"SELECT id, '{TRANSFERS}' AS service, '{p}' AS path, {_txt(p)} AS value FROM transfers"
        for p in (T_SOURCE_CHAIN, T_DESTINATION_CHAIN, T_AMOUNT, T_PRICE, T_FEE, T_ASSET))
    g = " UNION ALL ".join(
        f"SELECT id, '{GMP}' AS service, '{p}' AS path, {_txt(p)} AS value FROM gmp"
        for p in (
            G_SOURCE_CHAIN, G_DESTINATION_CHAIN, G_USER, G_AMOUNT, G_VALUE, G_GAS_USED, G_GAS_USD, G_EXPRESS_FEE, G_SYMBOL, G_CONTRACT))
    return _with() + t + " UNION ALL " + g


NUMBER_SITES = (
    ("transfers", "Token Transfers", "$.send.amount"), ("transfers", "Token Transfers", "$.link.price"),
    ("transfers", "Token Transfers", "$.send.fee_value"), ("gmp", "GMP", "$.amount"), ("gmp", "GMP", "$.value"),
    ("gmp", "GMP", "$.gas.gas_used_amount"), ("gmp", "GMP", "$.gas_price_rate.source_token.token_price.usd"),
    ("gmp", "GMP", "$.fees.express_fee_usd"),
)


def _number_sites(read, name: str) -> str:
    return _with() + " UNION ALL ".join(
        f"SELECT id, '{s}' AS service, '{p}' AS path, {read(p)} AS {name} FROM {f}" for f, s, p in NUMBER_SITES)


def _by_service(measure: str) -> str:
    return _with(EVENTS) + f"SELECT service, {measure} FROM ev GROUP BY service"


def oracle_sql() -> dict[str, str]:
    ts_month = _time_series("month")
    q: dict[str, str] = {
        "scan_transfers": _with() + "SELECT id, status, CAST(created_at AS DATE) AS created_date FROM transfers",
        "scan_gmp": _with() + "SELECT id, status, CAST(created_at AS DATE) AS created_date FROM gmp",
        "filter_status": _with() + " UNION ALL ".join(
            f"SELECT '{s}' AS service, id, count(*) AS n_rows FROM {f} "
            "WHERE status = 'executed' AND simplified_status = 'received' GROUP BY id"
            for f, s in (("transfers", "Token Transfers"), ("gmp", "GMP"))),
        "filter_router_transfers": _with() + ("SELECT id, sender_address FROM transfers "
                                              f"WHERE {_routers('sender_address')}"),
        "filter_router_gmp": _with() + (f"SELECT id, {_txt(G_CONTRACT)} AS contract_address FROM gmp "
                                        f"WHERE {_routers(_txt(G_CONTRACT))}"),
        "filter_date_outer": _with(EVENTS) + f"SELECT {EV_COLS} FROM ev WHERE {_day_range()}",
        "filter_date_branch": _with(EVENTS_RANGED) + f"SELECT {EV_COLS} FROM ev",
        "json_path": _json_long(),
        "json_kind": _number_sites(_kind, "kind"),
        "safe_number": _number_sites(_num, "value"),
        "amount_usd": _with() + f"SELECT id, {_product(T_AMOUNT, T_PRICE)} AS amount_usd FROM transfers",
        "fee_coalesce": _with() + (f"SELECT id, coalesce({_product(G_GAS_USED, G_GAS_USD)}, "
                                   f"{_num(G_EXPRESS_FEE)}) AS fee FROM gmp"),
        "normalize_chain": _with() + (
            f"SELECT DISTINCT c AS original_chain, lower(c) AS normalized_chain FROM ("
            f"SELECT {_txt(T_SOURCE_CHAIN)} AS c FROM transfers UNION ALL "
            f"SELECT {_txt(T_DESTINATION_CHAIN)} AS c FROM transfers)"),
        "union_services": _by_service("count(*) AS n_rows"),
        "bridge_events": _with(EVENTS) + f"SELECT {EV_COLS} FROM ev",
        "agg_distinct_ids": _by_service("count(DISTINCT id) AS number_of_transfers"),
        "agg_distinct_users": _by_service('count(DISTINCT "user") AS number_of_users'),
        "agg_volume": _by_service("round(sum(amount_usd)) AS volume_usd"),
        "agg_median": _by_service("round(median(amount_usd)) AS median_bridged_volume"),
        "agg_max": _by_service("round(max(amount_usd)) AS maximum_bridged_volume"),
        "agg_avg": _by_service("round(avg(amount_usd)) AS average_bridged_volume, "
                               "avg(amount_usd) AS avg_bridged_volume"),
        "avg_bridges_per_user": f"SELECT date, avg_bridge_count_per_user FROM ({ts_month})",
        "running_volume": f"SELECT date, bridged_volume, total_bridged_volume FROM ({ts_month})",
        "running_count": f"SELECT date, number_of_bridges, total_number_of_bridges FROM ({ts_month})",
        "kpi": _with(EVENTS) + _kpi_select(),
        "kpi_labels": _with(EVENTS, f"k AS ({_kpi_select()})") + (
            f"SELECT {_usd('volume_of_transfers')} AS bridged_volume, "
            f"{_count('number_of_transfers', 'Txns')} AS total_bridges, "
            f"{_count('number_of_users', 'Addresses')} AS total_bridgers, "
            f"{_usd('median_bridged_volume')} AS median_bridged_volume, "
            f"{_usd('maximum_bridged_volume')} AS maximum_bridged_volume, "
            f"{_usd('average_bridged_volume')} AS average_bridged_volume FROM k"),
        "time_series_month": ts_month,
        "time_series_week": _time_series("week"),
        "time_series_day": _time_series("day"),
        "source_chain": _chain("source_chain") + "SELECT * FROM r",
        "destination_chain": _chain("destination_chain") + "SELECT * FROM r",
        "source_chain_ranged": _chain_ranged("source_chain"),
        "destination_chain_ranged": _chain_ranged("destination_chain"),
        "source_chain_labels": _chain("source_chain") + (
            f"SELECT *, {_si('volume_usd')} AS volume_label, "
            "CAST(number_of_transfers AS VARCHAR) AS count_label FROM r"),
        "destination_chain_labels": _chain("destination_chain") + (
            f"SELECT *, {_usd('volume_usd')} AS volume_label, "
            f"{_count('number_of_transfers')} AS count_label FROM r"),
        "top10_source_volume": _top("source_chain", "volume"),
        "top10_source_count": _top("source_chain", "count"),
        "top10_destination_volume": _top("destination_chain", "volume"),
        "top10_destination_count": _top("destination_chain", "count"),
    }
    ev_ctes = (EVENT_FACTS, _te("et"))
    q["events_time_series_day"] = _time_series("day", ev_ctes, "te", EVENT_RANGE)
    q["events_time_series_week"] = _time_series("week", ev_ctes, "te", EVENT_RANGE)
    q["events_kpi"] = _with(*ev_ctes) + _kpi_select("te", EVENT_RANGE)
    q["report_sink"] = q["source_chain"]
    q["display_names"] = _chain("source_chain") + (
        'SELECT source_chain AS "Source Chain", number_of_transfers AS "Number of Transfers", '
        'number_of_users AS "Number of Users", volume_usd AS "Volume of Transfers (USD)" FROM r')
    march = "CAST(created_at AS DATE) BETWEEN DATE '1996-03-01' AND DATE '1996-03-31'"
    may = "CAST(created_at AS DATE) BETWEEN DATE '1997-05-01' AND DATE '1997-05-31'"
    q["reingest_bridge_events"] = _with(EVENTS) + (
        f"SELECT {EV_COLS} FROM ev WHERE NOT ({may}) AND NOT (service = 'GMP' AND {march})")
    q["bridge_events_variant"] = q["bridge_events"]
    q["saved_bridge_events"] = q["bridge_events"]
    q["kpi_saved"] = q["kpi"]
    q["time_series_day_saved"] = q["time_series_day"]
    return q
