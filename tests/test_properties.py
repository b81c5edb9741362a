"""Property tests: guarded numbers against a plain-Python model."""

import json
import math
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bridgelens.config import NUMBER_PATTERN
from bridgelens.functions.json import json_text
from bridgelens.functions.numbers import safe_number

_ALPHABET = "0123456789+-.eE dfinaINFx_"


def _model(text):
    if text is None or not re.search(NUMBER_PATTERN, text):
        return None
    x = float(text)
    return x if math.isfinite(x) else None


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet=_ALPHABET, max_size=12), min_size=1, max_size=300))
def test_safe_number_matches_model(spark, texts):
    docs = [(i, json.dumps({"a": t})) for i, t in enumerate(texts)]
    df = spark.createDataFrame(docs, "i int, data string")
    got = {r.i: r.n for r in df.select("i", safe_number(json_text(F.try_parse_json("data"), "$.a")).alias("n")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == _model(t), t


@settings(max_examples=5, deadline=None)
@given(st.lists(st.one_of(st.integers(-10**15, 10**15), st.floats(allow_nan=False, allow_infinity=False,
                                                               width=64)), min_size=1, max_size=200))
def test_json_numbers_round_trip(spark, values):
    docs = [(i, json.dumps({"a": v})) for i, v in enumerate(values)]
    df = spark.createDataFrame(docs, "i int, data string")
    got = {r.i: r.n for r in df.select("i", safe_number(json_text(F.try_parse_json("data"), "$.a")).alias("n")).collect()}
    for i, v in enumerate(values):
        assert got[i] == float(v), v


# --- reports against a brute-force model on random small inputs ---------------

from datetime import date, datetime, timedelta  # noqa: E402
from decimal import ROUND_HALF_UP, Decimal  # noqa: E402

from bridgelens import bridge_events, kpi, time_series  # noqa: E402
from bridgelens.sources.fixtures import TEST_ROUTERS  # noqa: E402

_ROW = st.tuples(
    st.integers(0, 70),                       # day offset from 2024-01-01
    st.integers(0, 86399),                    # second of day
    st.one_of(st.none(), st.integers(0, 6)),  # user
    st.integers(0, 25),                       # id (repeats on purpose)
    st.one_of(st.integers(0, 50), st.just("x")),  # amount (text = not a number)
    st.integers(1, 1000),                     # price
)


def _round_half_up(x, places=0):
    if x is None:
        return None
    q = Decimal(1) if places == 0 else Decimal(1).scaleb(-places)
    return float(Decimal(repr(x)).quantize(q, rounding=ROUND_HALF_UP))


def _bucket(d: date, unit: str) -> date:
    if unit == "month":
        return d.replace(day=1)
    if unit == "week":
        return d - timedelta(days=d.weekday())
    return d


def _facts(spark, rows):
    from helpers import facts, transfer
    base = datetime(2024, 1, 1)
    tr = [transfer(i, str(base + timedelta(days=o, seconds=s)), user=None if u is None else f"u{u}",
                   amount=a, price=p) for o, s, u, i, a, p in rows]
    return facts(spark, tr)


@settings(max_examples=4, deadline=None)
@given(st.lists(_ROW, min_size=1, max_size=60))
def test_time_series_matches_brute_force(spark, rows):
    t, g = _facts(spark, rows)
    ev = bridge_events(t, g, TEST_ROUTERS)
    start, end = date(2024, 1, 10), date(2024, 3, 1)
    for unit in ("month", "week", "day"):
        got = [r.asDict() for r in time_series(ev, start, end, unit).collect()]
        groups = {}
        for o, s, u, i, a, p in rows:
            d = date(2024, 1, 1) + timedelta(days=o)
            if not start <= d <= end:
                continue
            usd = None if a == "x" else float(a) * p
            groups.setdefault(_bucket(d, unit), []).append((i, u, usd))
        want, run_v, run_n = [], 0.0, 0
        for b in sorted(groups):
            items = groups[b]
            ids = len({i for i, _, _ in items})
            users = len({u for _, u, _ in items if u is not None})
            vals = [v for _, _, v in items if v is not None]
            vol = _round_half_up(sum(vals)) if vals else None
            run_v = run_v + vol if vol is not None else run_v
            run_n += ids
            want.append({"date": b, "number_of_bridges": ids, "number_of_bridgers": users, "bridged_volume": vol,
                         "total_bridged_volume": run_v if any(
                             x is not None for x in [w["bridged_volume"] for w in want] + [vol]) else None,
                         "total_number_of_bridges": run_n,
                         "avg_bridge_count_per_user": _round_half_up(ids / users, 1) if users else None,
                         "avg_bridged_volume": (sum(vals) / len(vals)) if vals else None})
        assert len(got) == len(want), unit
        for gr, wr in zip(got, want):
            for k, v in wr.items():
                if k == "avg_bridged_volume" and v is not None:
                    assert abs(gr[k] - v) <= 1e-9 * max(1.0, abs(v)), (unit, k)
                else:
                    assert gr[k] == v, (unit, k, gr[k], v)


@settings(max_examples=4, deadline=None)
@given(st.lists(_ROW, min_size=1, max_size=60))
def test_kpi_matches_brute_force(spark, rows):
    t, g = _facts(spark, rows)
    r = kpi(bridge_events(t, g, TEST_ROUTERS)).first()
    vals = sorted(float(a) * p for _, _, _, _, a, p in rows if a != "x")
    assert r.number_of_transfers == len({i for _, _, _, i, _, _ in rows})
    assert r.number_of_users == len({u for _, _, u, _, _, _ in rows if u is not None})
    if vals:
        n = len(vals)
        med = vals[(n - 1) // 2] + (vals[n // 2] - vals[(n - 1) // 2]) * 0.5
        assert r.median_bridged_volume == _round_half_up(med)
        assert r.volume_of_transfers == _round_half_up(sum(vals))
        assert r.maximum_bridged_volume == max(vals)
    else:
        assert r.median_bridged_volume is None and r.volume_of_transfers is None


_CHAIN_ROW = st.tuples(
    st.booleans(),                                          # GMP (True) or transfer
    st.one_of(st.none(), st.sampled_from(["Eth", "eth", "Arb", "Base", "Sol"])),  # source chain
    st.integers(0, 12),                                     # id
    st.integers(0, 4),                                      # user
    st.one_of(st.integers(1, 5), st.just("x")),            # amount / value
)


@settings(max_examples=4, deadline=None)
@given(st.lists(_CHAIN_ROW, min_size=1, max_size=50))
def test_chain_reports_and_top10_match_brute_force(spark, rows):
    from helpers import facts, gmp, transfer
    from bridgelens import source_chains, top_chains

    tr = [transfer(i, "2024-01-02 00:00:00", user=f"u{u}", amount=a, price=10, src=c)
          for is_g, c, i, u, a in rows if not is_g]
    gm = [gmp(i, "2024-01-02 00:00:00", user=f"u{u}", value=a if a == "x" else a * 10, src=c)
          for is_g, c, i, u, a in rows if is_g]
    t, g = facts(spark, tr, gm)
    rep = {r.source_chain: r for r in source_chains(bridge_events(t, g, TEST_ROUTERS)).collect()}
    model = {}
    for is_g, c, i, u, a in rows:
        key = c if (is_g or c is None) else c.lower()       # transfers lower-case, GMP keeps case
        m = model.setdefault(key, [set(), set(), []])
        m[0].add(i)
        m[1].add(f"u{u}")
        if a != "x":
            m[2].append(a * 10.0)
    assert set(rep) == set(model)
    for key, (ids, users, vals) in model.items():
        r = rep[key]
        assert (r.number_of_transfers, r.number_of_users) == (len(ids), len(users))
        assert r.volume_usd == (_round_half_up(sum(vals)) if vals else None)
    ranked = sorted(model.items(), key=lambda kv: (
        kv[1][2] == [], -(sum(kv[1][2]) if kv[1][2] else 0), -len(kv[1][0]), kv[0] is not None, kv[0] or ""))
    top = [r.source_chain for r in top_chains(source_chains(bridge_events(t, g, TEST_ROUTERS)), "volume").collect()]
    assert top == [k for k, _ in ranked[:10]]
