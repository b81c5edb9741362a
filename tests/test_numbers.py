import pytest
from pyspark.sql import functions as F

from bridgelens.functions.json import json_kind, json_text
from bridgelens.functions.numbers import safe_number

CASES = [
    ('{"a": 17}', 17.0, "scalar"),
    ('{"a": "17"}', 17.0, "scalar"),
    ('{"a": " 2 "}', 2.0, "scalar"),
    ('{"a": -3.5e2}', -350.0, "scalar"),
    ('{"a": ".5"}', 0.5, "scalar"),
    ('{"a": "5."}', 5.0, "scalar"),
    ('{"a": true}', None, "scalar"),
    ('{"a": false}', None, "scalar"),
    ('{"a": null}', None, "null"),
    ('{"a": []}', None, "array"),
    ('{"a": [1]}', None, "array"),
    ('{"a": {}}', None, "object"),
    ('{"a": {"x": 1}}', None, "object"),
    ('{"a": ""}', None, "scalar"),
    ('{"a": "abc"}', None, "scalar"),
    ('{"a": "1d"}', None, "scalar"),
    ('{"a": "1f"}', None, "scalar"),
    ('{"a": "inf"}', None, "scalar"),
    ('{"a": "Infinity"}', None, "scalar"),
    ('{"a": "NaN"}', None, "scalar"),
    ('{"a": "1_000"}', None, "scalar"),
    ('{"a": "0x10"}', None, "scalar"),
    ('{"a": 1e400}', None, "scalar"),
    ('{"a": "1e400"}', None, "scalar"),
    ('{"b": 1}', None, None),
    ("not json", None, None),
]


@pytest.fixture(scope="module")
def parsed(spark):
    df = spark.createDataFrame([(i, d) for i, (d, _, _) in enumerate(CASES)], "i int, data string")
    v = F.try_parse_json("data")
    out = df.select("i", safe_number(json_text(v, "$.a")).alias("n"), json_kind(v, "$.a").alias("k"))
    return {r.i: (r.n, r.k) for r in out.collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_safe_number_and_kind(parsed, i):
    doc, want_n, want_k = CASES[i]
    n, k = parsed[i]
    assert n == want_n, doc
    assert k == want_k, doc


def test_nan_never_reaches_a_sum(spark):
    df = spark.createDataFrame([('{"a": "NaN"}',), ('{"a": 2}',)], "data string")
    total = df.select(F.sum(safe_number(json_text(F.try_parse_json("data"), "$.a")))).first()[0]
    assert total == 2.0
