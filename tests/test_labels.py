import pytest
from pyspark.sql import functions as F

from bridgelens.functions.labels import count_label, si_label, usd_label

SI = [
    (32325072166.0, "32G"), (1234.0, "1.2k"), (999.5, "1.0k"), (0.0, "0.0"), (12.0, "12"),
    (0.5, "500m"), (120000.0, "120k"), (1.0, "1.0"), (999.0, "1.0k"), (45.0, "45"), (None, None),
    (1.5e9, "1.5G"), (0.0012, "1.2m"), (-1234.0, "\u22121.2k"), (-32.0, "\u221232"),
]


@pytest.mark.parametrize("x,want", SI)
def test_si_label(spark, x, want):
    got = spark.createDataFrame([(x,)], "x double").select(si_label(F.col("x"))).first()[0]
    assert got == want


def test_usd_and_count_labels(spark):
    r = spark.createDataFrame([(383322465963.0, 5525)], "v double, n bigint").select(
        usd_label(F.col("v")), count_label(F.col("n"), "Txns"), count_label(F.col("n"))).first()
    assert tuple(r) == ("$383,322,465,963", "5,525 Txns", "5,525")
