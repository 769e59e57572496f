from pyspark.sql import functions as F

from rasterloom.functions import color as C


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


def test_hex_both_ways(spark):
    r, g, b = (one(spark, c) for c in C.hex_channels(F.lit("#1f2937")))
    assert (r, g, b) == (31, 41, 55) == C.hex_ints("#1f2937")
    assert one(spark, C.rgb_hex(F.lit(0), F.lit(255), F.lit(10))) == "#00ff0a"


def test_rounding_half_to_even_and_half_up(spark):
    assert [one(spark, C.store(F.lit(v))) for v in (0.5, 1.5, 2.5, -3.0, 300.0)] == [0, 2, 2, 0, 255]
    assert [one(spark, C.half_up(F.lit(v))) for v in (0.5, 1.5, -0.5)] == [1, 2, 0]


def test_format_bytes(spark):
    for n, shown in ((0, "0 B"), (1023, "1023 B"), (1024, "1 KB"), (1536, "1.5 KB"), (5 * 1024**3, "5 GB"), (2**42, "4096 GB")):
        assert one(spark, C.format_bytes(F.lit(n).cast("long"))) == shown


def test_custom_id(spark):
    assert one(spark, C.custom_id(F.lit("  My Preset!! 2 "))) == "custom-my-preset-2"
    assert one(spark, C.custom_id(F.lit("!!!"), F.lit("k1"))) == "custom-k1"


def test_names_and_modes(spark):
    assert [one(spark, C.colour_name(F.lit(c))) for c in ("#ffffff", "#000000", "#c8c8c8", "#404040", "#808080", "#ff0000")] == ["white", "black", "light gray", "dark gray", "gray", "#FF0000"]
    assert one(spark, C.restore_mode(F.lit("#dc2626"))) == "solid"
    assert one(spark, C.restore_mode(F.lit("#ffffff"))) == "original"


def test_filters_sum_and_centre(spark):
    for name, radius in C.FILTER_RADIUS.items():
        assert one(spark, C.filter_weight(F.lit(0.0), name)) == 1.0
        assert one(spark, C.filter_weight(F.lit(float(radius)), name)) == 0.0
