"""Fact tables stored as VARIANT Parquet or as ORC give the same events."""

from pyspark.sql import functions as F

from bridgelens import bridge_events
from bridgelens.session import scratch_path
from bridgelens.sources import TEST_ROUTERS, fixture_gmp, fixture_transfers, read_gmp, read_transfers

SF = "/root/testdata/sf0.001"


def _rows(df):
    return sorted(tuple("" if v is None else str(v) for v in r) for r in df.collect())


def test_variant_stored_facts(spark):
    t, g = fixture_transfers(spark, SF), fixture_gmp(spark, SF)
    tp, gp = scratch_path(spark, "var-t"), scratch_path(spark, "var-g")
    t.withColumn("data", F.parse_json("data")).write.parquet(tp)
    g.withColumn("data", F.parse_json("data")).write.parquet(gp)
    tv, gv = read_transfers(spark, tp), read_gmp(spark, gp)
    assert tv.schema["data"].dataType.simpleString() == "variant"
    ev = bridge_events(tv, gv, TEST_ROUTERS)
    assert _rows(ev) == _rows(bridge_events(t, g, TEST_ROUTERS))
    # nothing is re-parsed: the stored VARIANT is read as is
    assert "parseJson" not in ev._jdf.queryExecution().executedPlan().toString()


def test_orc_facts(spark):
    t, g = fixture_transfers(spark, SF), fixture_gmp(spark, SF)
    tp, gp = scratch_path(spark, "orc-t"), scratch_path(spark, "orc-g")
    t.write.orc(tp)
    g.write.orc(gp)
    ev = bridge_events(read_transfers(spark, tp, "orc"), read_gmp(spark, gp, "orc"), TEST_ROUTERS)
    assert _rows(ev) == _rows(bridge_events(t, g, TEST_ROUTERS))


def test_variant_gmp_scan_reads_the_wanted_paths_only(spark):
    """Stored VARIANT: the scan lists the paths that are used, for either branch."""
    from pyspark.sql import functions as F

    from bridgelens.operators.extract import gmp_events, transfer_events
    from bridgelens.session import scratch_path
    from bridgelens.sources.fixtures import TEST_ROUTERS, fixture_gmp, fixture_transfers

    sf = "/root/testdata/sf0.001"
    for facts, branch in ((fixture_gmp, gmp_events), (fixture_transfers, transfer_events)):
        path = scratch_path(spark, "variant-facts")
        facts(spark, sf).withColumn("data", F.try_parse_json("data")).write.parquet(path)
        stored = spark.read.parquet(path)
        out = branch(stored, TEST_ROUTERS)
        plan = out.select("amount_usd", "raw_asset")._jdf.queryExecution().executedPlan().toString()
        schema = plan[plan.index("ReadSchema"):]
        assert "data:struct<0:" in schema and ":variant" not in schema.split("\n")[0]
        text = branch(facts(spark, sf), TEST_ROUTERS)
        key = lambda r: tuple("" if v is None else str(v) for v in r)
        assert sorted(map(key, out.collect())) == sorted(map(key, text.collect()))


def test_text_prefilter_keeps_escaped_addresses(spark):
    from bridgelens.operators.extract import gmp_events
    from helpers import facts, gmp
    from bridgelens.sources.fixtures import TEST_ROUTERS

    row = list(gmp(1, "2024-01-01 00:00:00", contract=TEST_ROUTERS[0]))
    row[-1] = row[-1].replace("0xa1", "0x\\u0061\u0031".replace("\u0031", "1"))
    _, g = facts(spark, [], [tuple(row), gmp(2, "2024-01-01 00:00:00", contract="0xdead")])
    assert [r.id for r in gmp_events(g, TEST_ROUTERS).collect()] == [1]


def test_variant_store_is_unshredded_and_paths_are_read_above_the_scan(spark, monkeypatch):
    """The query's stored facts are whole documents (shredding cost more than the parse), and only rows that pass pay for
    their paths; the session's setting stays as it was."""
    import glob

    import pyarrow.parquet as pq

    from bridgelens import catalog
    from bridgelens.sources.tables import SHREDDING

    kept, old = [], spark.conf.get(SHREDDING, None)
    store = catalog.store_variant
    monkeypatch.setattr(catalog, "store_variant", lambda *a: kept.extend(store(*a)) or kept)
    out = catalog.bridge_events_variant(spark, SF)
    assert spark.conf.get(SHREDDING, None) == old
    for path in kept:
        for f in glob.glob(f"{path.removeprefix('file:')}/*.parquet"):
            assert "typed_value" not in str(pq.ParquetFile(f).schema)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "data:struct<0:va" in plan and "data:struct<0:string" not in plan and "parseJson" not in plan
    rows = _rows(out)
    assert rows and rows == _rows(bridge_events(fixture_transfers(spark, SF), fixture_gmp(spark, SF), TEST_ROUTERS))


def test_paths_above_the_scan_give_the_same_rows_on_odd_documents(spark):
    from helpers import G_SCHEMA, T_SCHEMA, gmp, transfer

    ts = [transfer(1, "2024-01-01 00:00:00"), transfer(2, "2024-01-02 00:00:00", amount=[1], price="x", fee=None),
          transfer(3, "2024-01-03 00:00:00", sender=None), transfer(4, "2024-01-04 00:00:00", status="pending"),
          (*transfer(5, "2024-01-05 00:00:00")[:-1], "{broken"), (*transfer(6, "2024-01-06 00:00:00")[:-1], None), transfer(6, "2024-01-06 00:00:00")]
    gs = [gmp(1, "2024-01-01 00:00:00"), gmp(2, "2024-01-02 00:00:00", contract="0xdead"), gmp(3, "2024-01-03 00:00:00", contract=None),
          (*gmp(4, "2024-01-04 00:00:00")[:-1], "{broken"), (*gmp(5, "2024-01-05 00:00:00")[:-1], None), gmp(6, "2024-01-06 00:00:00", gas="x", express=7)]
    from bridgelens.sources import store_variant

    t, g = spark.createDataFrame(ts, T_SCHEMA), spark.createDataFrame(gs, G_SCHEMA)
    tp, gp = store_variant(spark, {"transfers": t, "gmp": g})
    tv, gv = read_transfers(spark, tp), read_gmp(spark, gp)
    for kw in ({}, {"start": "2024-01-02", "end": "2024-01-05"}, {"start": "2024-01-02", "filter_in_branches": False}):
        above = bridge_events(tv, gv, TEST_ROUTERS, paths_in_scan=False, **kw)
        want = _rows(bridge_events(t, g, TEST_ROUTERS, **kw))
        assert want and _rows(above) == want == _rows(bridge_events(tv, gv, TEST_ROUTERS, **kw))
