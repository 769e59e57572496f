import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.operators import catalog as L
from rasterloom.operators import critique as Q
from rasterloom.plans import history as H
from rasterloom.plans import pipelines as PL
from rasterloom.sources import images as I
from rasterloom.sources.fixtures import raster


def test_png_round_trip_and_filters():
    rng = np.random.default_rng(2)
    raw = rng.integers(0, 256, (5, 7, 4), dtype=np.uint8).tobytes()
    png = I.encode_png(raw, 7, 5)
    assert I.decode_png(png) == (7, 5, raw)
    with pytest.raises(ValueError):
        I.decode_png(b"GIF89a")


@pytest.mark.parametrize("mode", [0, 1, 2, 3, 4])
def test_png_line_filters(mode):
    """A picture filtered by hand decodes to itself."""
    import struct
    import zlib

    rng = np.random.default_rng(mode)
    img = rng.integers(0, 256, (4, 6 * 3)).astype(int)
    lines, prior = [], np.zeros(18, int)
    for row in img:
        left = np.concatenate([np.zeros(3, int), row[:-3]])
        corner = np.concatenate([np.zeros(3, int), prior[:-3]])
        p = left + prior - corner
        paeth = np.where((abs(p - left) <= abs(p - prior)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - prior) <= abs(p - corner), prior, corner))
        guess = [0 * row, left, prior, (left + prior) // 2, paeth][mode]
        lines.append(bytes([mode]) + bytes(((row - guess) % 256).astype(np.uint8)))
        prior = row
    png = I.SIGNATURE + I.chunk(b"IHDR", struct.pack(">IIBBBBB", 6, 4, 8, 2, 0, 0, 0)) + I.chunk(b"IDAT", zlib.compress(b"".join(lines))) + I.chunk(b"IEND", b"")
    w, h, rgba = I.decode_png(png)
    assert (np.frombuffer(rgba, np.uint8).reshape(h, w, 4)[..., :3].reshape(4, 18) == img).all()


def test_dpi_chunk_is_idempotent():
    png = I.encode_png(bytes(16), 2, 2)
    a = I.set_png_dpi(png, 300)
    assert I.set_png_dpi(a, 300) == a and round(I.png_dpi(a)) == 300
    assert I.set_png_dpi(I.set_png_dpi(png, 72), 300) == a
    assert I.set_png_dpi(b"other", 300) == b"other"
    assert I.remove_chunk(a, b"pHYs") == png


def test_folder_scan_and_sink(spark, sf, tmp_path):
    tiles = raster(spark, sf, "event").where("image_id < 2")
    done = I.write_files(I.encode(I.from_pixels(tiles), dpi=300), str(tmp_path / "out")).collect()
    assert len(done) == 2
    back = I.to_pixels(I.load_images(spark, str(tmp_path / "out")))
    assert back.count() == tiles.count() and back.agg(F.sum("r")).first()[0] == tiles.agg(F.sum("r")).first()[0]


def test_audit_pairs(spark):
    files = spark.createDataFrame([("/d/a.png", b"1"), ("/d/a - text removed.png", b"2"), ("/d/b - text removed.png", b"3")], "path string, content binary")
    r = I.audit_pairs(files).collect()
    assert [(x["original"], bytes(x["content"]), bytes(x["original_content"])) for x in r] == [("/d/a.png", b"2", b"1")]
    assert spark.range(1).select(I.output_name(F.lit("x.PNG"))).first()[0] == "x - text removed.png"


def test_unknown_encoder_and_hooks(spark, sf):
    img = I.from_pixels(raster(spark, sf, "event"))
    with pytest.raises(NotImplementedError):
        I.encode(img, "webp")
    with pytest.raises(NotImplementedError):
        PL.remove_background_ai(img)
    with pytest.raises(NotImplementedError):
        PL.render_text_layers(img)
    assert PL.remove_background_ai(img, lambda frames: frames).count() == img.count()


def test_stream_of_images(spark, sf, tmp_path):
    from rasterloom.streaming import folders

    I.write_files(I.encode(I.from_pixels(raster(spark, sf, "event"))), str(tmp_path / "in")).collect()
    q = folders.run_operator(folders.image_stream(spark, str(tmp_path / "in")), folders.stats_to(str(tmp_path / "stats")), str(tmp_path / "cp"))
    q.awaitTermination()
    events = spark.read.parquet(f"{sf}/events.parquet").count()
    assert spark.read.parquet(str(tmp_path / "stats")).count() == -(-events // 256)


def test_presets(spark):
    p = L.bg_removal_presets(spark)
    new = p.where("id = 'logo-on-white'").withColumn("name", F.lit("N"))
    up = L.upsert_preset(p, new)
    assert up.count() == 5 and up.orderBy(F.desc("ordinal")).first()["name"] == "N"
    assert L.delete_preset(up, "logo-on-white").count() == 4


def test_critiques(spark):
    say = lambda t: spark.range(1).select(Q.parse_critique(F.lit(t)).alias("c")).first()["c"]
    assert say("   ") == [] and say(None) == [] and say("fine") == []
    assert say("There is a HALO and the edges are jagged") == ["edge-halo", "edge-jaggy"]
    assert say("haloed") == []


def test_consensus_ties_and_single(spark):
    fin = (True, 128, 1, False)
    rows = [("a", 1, ("#000000", 10.0, "global", 1.0, fin)), ("a", 2, ("#ffffff", 13.0, "flood", 2.0, (False, 129, 2, True))), ("a", 3, None), ("b", 1, ("#111111", 7.25, "global", 0.5, fin)), ("c", 1, None)]
    s = spark.createDataFrame(rows, f"group_id string, seq int, accepted {__import__('rasterloom.schema', fromlist=['PARAMS']).PARAMS}")
    out = {r["group_id"]: r for r in Q.aggregate_samples(s, "group_id").collect()}
    assert set(out) == {"a", "b"}
    a = out["a"]
    assert (a["color"], a["tolerance"], a["strategy"], a["edge_feather"], a["solid_edges"], a["alpha_threshold"], a["choke"], a["despill"]) == ("#000000", 12.0, "flood", 2.0, True, 129, 2, True)
    assert (out["b"]["tolerance"], out["b"]["strategy"]) == (7.25, "global")


def test_history(spark):
    steps = spark.createDataFrame([("s", i, str(i)) for i in range(25)], "session_id string, seq int, label string")
    kept = H.capped(steps)
    at = kept.groupBy("session_id").agg(F.max("seq").alias("at"))
    back = H.undo(kept, at)
    assert H.current(kept, back).first()["label"] == "23"
    new, head = H.push(kept, back, spark.createDataFrame([("s", "x")], "session_id string, label string"))
    assert head.first()["at"] == 24 and new.where("seq = 24").first()["label"] == "x"
    assert H.redo(new, head).first()["at"] == 24 and H.start_over(new)[0].count() == 1


def test_letters_go_and_the_disc_stays(spark, sf):
    from rasterloom import queries as q

    out = q.queries()["remove_text_letters"](spark, sf).collect()
    assert len(out) == 5 and all(300 < r["still_visible"] < 600 and r["lowest"] == 177 for r in out)


def test_scenes_are_drawn_as_their_sql_says_without_a_shuffle_of_pixels(spark, sf):
    from rasterloom.sources import fixtures

    drawn, said = fixtures.scene(spark, sf), fixtures._spark_sql(spark, sf, "scene")
    assert [t for _, t in drawn.dtypes] == [t for _, t in said.dtypes]
    assert drawn.exceptAll(said).isEmpty() and said.exceptAll(drawn).isEmpty() and drawn.count() == said.count()
    plan = drawn._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
