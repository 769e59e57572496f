"""Every registered query of the raster engine, each beside the SQL that checks it (where SQL can).

Rasters come from ``sources.fixtures``: the SQL repeats their derivation, then states the operator independently.
Whole pixel relations are returned for the small rasters; for ``scene`` (64 x 64, the large one) one checksum an image.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import expected as X
from .functions import color as C
from .operators import aggregate as A
from .operators import catalog as L
from .operators import critique as Q
from .operators import detect as D
from .operators import geometry as G
from .operators import graph as R
from .operators import kernels as K
from .operators import packed as TP
from .operators import point as P
from .operators import relax as RX
from .operators import text as T
from .operators import trace as TR
from .operators import window as N
from .plans import history as H
from .plans import pipelines as PL
from .scratch import folder, settled
from .sources import audit as AU
from .sources import images as I
from .sources import sink as SK
from .sources.fixtures import SQL, raster, tiles

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

PIX = "image_id, x, y, r, g, b, a"
KEY = "(x*31+y*17+1)*(r*3+g*5+b*7+a*11)"
#: The same in Spark: x and y of a large image would overflow an int.
LONG_KEY = "(bigint(x)*31+bigint(y)*17+1)*(r*3+g*5+b*7+a*11)"


def add(name: str, fn: Query, sql: str | None = None) -> None:
    _QUERIES[name] = fn
    if sql:
        _SQL[name] = _doubles(sql)


def _doubles(sql: str) -> str:
    """Decimal literals as doubles, outside quoted text: DuckDB would compute with exact decimals."""
    parts = sql.split("'")
    return "'".join(p if i % 2 else re.sub(r"(?<![\w.])(\d+\.\d+)(?![\w.])", r"\1e0", p) for i, p in enumerate(parts))


def digest(df: DataFrame) -> DataFrame:
    return df.groupBy("image_id").agg(F.count("*").alias("n"), F.sum(F.expr(LONG_KEY).cast("long")).alias("checksum"))


def digest_sql(table: str) -> str:
    return f"SELECT image_id, count(*) AS n, CAST(sum({KEY}) AS BIGINT) AS checksum FROM {table} GROUP BY image_id"


def st(e: str) -> str:
    """A clamped byte store in SQL."""
    return f"CAST(round_even(least(255.0, greatest(0.0, CAST({e} AS DOUBLE))), 0) AS INTEGER)"


def src(fixture: str, ctes: str = "", recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}src AS MATERIALIZED ({SQL[fixture]}){', ' + ctes if ctes else ''} "


def on(fixture: str, op: Callable[[DataFrame], DataFrame], *, digested: bool = False) -> Query:
    return lambda spark, sf: digest(op(raster(spark, sf, fixture))) if digested else op(raster(spark, sf, fixture))


def point(name: str, fixture: str, op: Callable[[DataFrame], DataFrame], **channels: str) -> None:
    """A query of a point operator; channels give the new channels in SQL over r, g, b, a."""
    cols = ", ".join(f"CAST({channels.get(c, c)} AS INTEGER) AS {c}" for c in "rgba")
    add(f"{name}_{fixture}", on(fixture, lambda d: op(d).select(*PIX.split(", "))), src(fixture) + f"SELECT image_id, x, y, {cols} FROM src")


# -- sources and colour functions -------------------------------------------------------------------------------

for _f in ("scene", "embed", "event"):
    add(f"canvas_to_image_data_{_f}", on(_f, lambda d: d, digested=True), src(_f) + digest_sql("src"))


def _colours(spark: SparkSession, sf: str) -> DataFrame:
    return raster(spark, sf, "scene").select("r", "g", "b").distinct()


_COLOURS = src("scene", "c AS (SELECT DISTINCT r, g, b FROM src)")
_HEX = "lower(printf('#%02x%02x%02x', CAST(r AS INTEGER), CAST(g AS INTEGER), CAST(b AS INTEGER)))"
_SAT = "(CASE WHEN greatest(r,g,b)=0 THEN 0 ELSE (greatest(r,g,b)-least(r,g,b))/greatest(r,g,b) END)"
_LUMA = "(0.2126*r+0.7152*g+0.0722*b)"
_LUMA6 = "(r*0.299+g*0.587+b*0.114)"

add("rgb_to_hex_scene", lambda s, d: _colours(s, d).select("r", "g", "b", C.rgb_hex(F.col("r"), F.col("g"), F.col("b")).alias("hex")), _COLOURS + f"SELECT r, g, b, {_HEX} AS hex FROM c")


def _hex_to_rgb(spark: SparkSession, sf: str) -> DataFrame:
    hexes = _colours(spark, sf).select(C.rgb_hex(F.col("r"), F.col("g"), F.col("b")).alias("hex"))
    return hexes.select("hex", *[v.alias(c) for c, v in zip("rgb", C.hex_channels(F.col("hex")), strict=True)])


add("hex_to_rgb_scene", _hex_to_rgb, _COLOURS + f"SELECT {_HEX} AS hex, CAST(r AS INTEGER) AS r, CAST(g AS INTEGER) AS g, CAST(b AS INTEGER) AS b FROM c")
add("colour_saturation_scene", lambda s, d: _colours(s, d).select("r", "g", "b", C.saturation(F.col("r"), F.col("g"), F.col("b")).alias("sat")), _COLOURS + f"SELECT r, g, b, CAST({_SAT} AS DOUBLE) AS sat FROM c")
add("fringe_colour_embed", lambda s, d: raster(s, d, "embed").select("r", "g", "b").distinct().select("r", "g", "b", C.fringe_colour(F.col("r"), F.col("g"), F.col("b")).alias("fringe")),
    src("embed") + f"SELECT DISTINCT r, g, b, (greatest(r,g,b)>230 AND greatest(r,g,b)-least(r,g,b)<20 AND {_SAT}<0.08) OR (greatest(r,g,b)>180 AND greatest(r,g,b)<230 AND greatest(r,g,b)-least(r,g,b)<12 AND {_SAT}<0.06) AS fringe FROM src")
add("bg_color_name_scene", lambda s, d: _colours(s, d).select(C.rgb_hex(F.col("r"), F.col("g"), F.col("b")).alias("hex")).select("hex", C.colour_name(F.col("hex")).alias("name"), C.restore_mode(F.col("hex")).alias("mode")),
    _COLOURS + f"""SELECT {_HEX} AS hex, CASE WHEN {_SAT}<0.1 THEN CASE WHEN {_LUMA}>230 THEN 'white' WHEN {_LUMA}<25 THEN 'black' WHEN {_LUMA}>180 THEN 'light gray'
    WHEN {_LUMA}<80 THEN 'dark gray' ELSE 'gray' END ELSE upper({_HEX}) END AS name, CASE WHEN {_SAT}>0.55 AND {_LUMA}>40 AND {_LUMA}<220 THEN 'solid' ELSE 'original' END AS mode FROM c""")  # fmt: skip
add("color_distance_scene", lambda s, d: _colours(s, d).select("r", "g", "b", C.dist_sq("#1f2937").alias("d2")), _COLOURS + "SELECT r, g, b, CAST((r-31)*(r-31)+(g-41)*(g-41)+(b-55)*(b-55) AS INTEGER) AS d2 FROM c")
add("get_pixel_scene", on("scene", lambda d: A.pick_colour(d, 10, 20)), src("scene") + f"SELECT image_id, x, y, {_HEX} AS hex FROM src WHERE x=10 AND y=20")
add("smoothstep_embed", lambda s, d: raster(s, d, "embed").select("r").distinct().select("r", F.round(C.smoothstep(0.08, 0.16, F.col("r") / 1000), 9).alias("t")),
    src("embed") + "SELECT r, round(CASE WHEN v<=0.08 THEN 0.0 WHEN v>=0.16 THEN 1.0 ELSE u*u*(3-2*u) END, 9) AS t FROM (SELECT *, (v-0.08)/(0.16-0.08) AS u FROM (SELECT DISTINCT r, r/1000 AS v FROM src))")


def _format_bytes(spark: SparkSession, sf: str) -> DataFrame:
    o = spark.read.parquet(f"{sf}/orders.parquet")
    return o.select("o_orderkey", (F.floor(F.col("o_totalprice")) * F.col("o_orderkey")).cast("long").alias("n")).select("o_orderkey", "n", C.format_bytes(F.col("n")).alias("shown"))


add("format_bytes_orders", _format_bytes, r"""WITH o AS (SELECT o_orderkey, CAST(floor(o_totalprice)*o_orderkey AS BIGINT) AS n FROM orders),
 u AS (SELECT *, CASE WHEN n>=1073741824 THEN 3 WHEN n>=1048576 THEN 2 WHEN n>=1024 THEN 1 ELSE 0 END AS i FROM o)
SELECT o_orderkey, n, CASE WHEN n=0 THEN '0 B' ELSE regexp_replace(regexp_replace(printf('%.2f', n/pow(1024.0,i)), '(\.[0-9]*?)0+$', '\1'), '\.$', '') || ' ' || (['B','KB','MB','GB'])[i+1] END AS shown FROM u""")


def _custom_id(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", C.custom_id(F.concat(F.lit("  "), "p_name", F.lit("! "), "p_type", F.lit("--"))).alias("id"))


add("generate_custom_id_part", _custom_id, "SELECT p_partkey, 'custom-' || CASE WHEN s='' THEN 'unnamed' ELSE s END AS id FROM (SELECT p_partkey, regexp_replace(regexp_replace(trim(lower('  ' || p_name || '! ' || p_type || '--')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM part)")


def _units(spark: SparkSession, sf: str) -> DataFrame:
    px = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", (F.col("p_size") * 37).cast("double").alias("px"))
    cols = [C.round_unit(C.px_to_unit(F.col("px"), u, 300.0), u).cast("double").alias(f"to_{u}") for u in ("px", "in", "cm")]
    return px.select("p_partkey", *cols, *[F.round(C.unit_to_px(F.col("px"), u, 300.0), 6).alias(f"from_{u}") for u in ("px", "in", "cm")])


add("unit_conversion_part", _units, "SELECT p_partkey, floor(px+0.5) AS to_px, floor(px/300*100+0.5)/100 AS to_in, floor(px/300*2.54*100+0.5)/100 AS to_cm, round(px,6) AS from_px, round(px*300,6) AS from_in, round(px/2.54*300,6) AS from_cm FROM (SELECT p_partkey, CAST(p_size*37 AS DOUBLE) AS px FROM part)")

_SINC = "(sin(pi()*{x})/(pi()*{x}))"


def filter_sql(x: str, name: str) -> str:
    a = f"abs({x})"
    if name.startswith("lanczos"):
        n = name[-1]
        return f"CASE WHEN {a}<1e-8 THEN 1.0 WHEN {a}>={n} THEN 0.0 ELSE {_SINC.format(x=f'({x})')}*{_SINC.format(x=f'(({x})/{n}.0)')} END"
    if name == "bicubic":
        return f"CASE WHEN {a}<1 THEN 1.5*{a}*{a}*{a}-2.5*{a}*{a}+1 WHEN {a}<2 THEN -0.5*{a}*{a}*{a}+2.5*{a}*{a}-4*{a}+2 ELSE 0.0 END"
    return f"CASE WHEN {a}<1 THEN 1-{a} ELSE 0.0 END"


def _filters(spark: SparkSession, sf: str) -> DataFrame:
    x = spark.range(-70, 71).select((F.col("id") / 20).alias("x"))
    return x.select("x", *[(F.round(C.filter_weight(F.col("x"), n), 9) + 0.0).alias(n) for n in C.FILTER_RADIUS])


add("filter_fn", _filters, "SELECT x, " + ", ".join(f"round(CAST({filter_sql('x', n)} AS DOUBLE), 9)+0.0 AS {n}" for n in C.FILTER_RADIUS) + " FROM (SELECT i/20 AS x FROM range(-70, 71) t(i))")
add("filter_radius", lambda s, d: s.createDataFrame(list(C.FILTER_RADIUS.items()), "filter string, radius int"), "SELECT * FROM (VALUES ('lanczos3', CAST(3 AS INTEGER)), ('lanczos2', 2), ('bicubic', 2), ('bilinear', 1)) t(filter, radius)")
add("gaussian_kernel", lambda s, d: s.range(1).select(F.posexplode(C.gaussian_kernel(1.2, 3)).alias("i", "wt")).select("i", F.round("wt", 9).alias("wt")), "SELECT CAST(i+3 AS INTEGER) AS i, round(exp(-(i*i)/(2*1.2*1.2)), 9) AS wt FROM range(-3, 4) t(i)")
add("crc32", lambda s, d: s.createDataFrame([("IEND",), ("123456789",), ("",)], "text string").select("text", F.crc32(F.col("text").cast("binary")).alias("crc")), "SELECT * FROM (VALUES ('IEND', CAST(2923585666 AS BIGINT)), ('123456789', 3421780262), ('', 0)) t(text, crc)")


# -- point operators ---------------------------------------------------------------------------------------------------


def seen(e: str, c: str) -> str:
    return f"CASE WHEN a=0 THEN {c} ELSE {e} END"


_GRAY = f"floor({_LUMA}+0.5)"
for _f in ("event", "embed"):
    point("grayscale", _f, P.grayscale, **{c: seen(_GRAY, c) for c in "rgb"})
    point("invert", _f, P.invert, **{c: seen(f"255-{c}", c) for c in "rgb"})
    point("sepia", _f, P.sepia, **{c: seen(st(f"r*{x}+g*{y}+b*{z}"), c) for c, (x, y, z) in P.SEPIA.items()})
    point("brightness_contrast", _f, lambda d: P.brightness_contrast(d, 10, 20), **{c: st(f"({c}+10*1.275-128)*pow(1.2,2)+128") for c in "rgb"})
    point("saturation", _f, lambda d: P.saturate(d, 35), **{c: st(f"{_LUMA}+({c}-{_LUMA})*1.35") for c in "rgb"})
    point("vibrance", _f, lambda d: P.vibrance(d, 40), **{c: st(f"{_LUMA}+({c}-{_LUMA})*(1+0.4*(1-{_SAT}))") for c in "rgb"})
    point("shadow_highlight", _f, lambda d: P.shadow_highlight(d, 18, -10), **{c: st(f"{c}+0.18*90*pow(1-{_LUMA}/255,2)+(-0.1)*90*pow({_LUMA}/255,2)") for c in "rgb"})
    point("warmth", _f, lambda d: P.warmth(d, 30), r=st("r+0.3*25"), b=st("b-0.3*25"))
point("clean_alpha_edges", "event", lambda d: P.clean_alpha_edges(d, 0.2), a="CASE WHEN a<=32+0.2*64 THEN 0 WHEN a>=224-0.2*64 THEN 255 ELSE floor((a-(32+0.2*64))/((224-0.2*64)-(32+0.2*64))*255+0.5) END")
point("despill", "event", lambda d: P.despill(d, "#00b140"), g="CASE WHEN a>0 AND a<255 AND g>greatest(r,b) THEN greatest(r,b) ELSE g END")
point("flatten", "event", lambda d: P.flatten_background(d, "#ffe8c0"), **{c: st(f"{c}*(a/255)+{v}*(1-a/255)") for c, v in zip("rgb", (255, 232, 192), strict=True)}, a="255")
_NEAR = "a<>0 AND (r-200)*(r-200)+(g-60)*(g-60)+(b-150)*(b-150)<=pow(0.3,2)*195075"
point("replace_color", "event", lambda d: P.replace_color(d, "#c83c96", "#1f2937", 30, False), **{c: f"CASE WHEN {_NEAR} THEN {v} ELSE {c} END" for c, v in zip("rgb", (31, 41, 55), strict=True)})
_FROM, _TO = "(0.2126*200+0.7152*60+0.0722*150)", "(0.2126*31+0.7152*41+0.0722*55)"
point("replace_color_luma", "event", lambda d: P.replace_color(d, "#c83c96", "#1f2937", 30, True), **{c: f"CASE WHEN {_NEAR} THEN {st(f'{v}+({_LUMA}-{_FROM})*({v}/{_TO})')} ELSE {c} END" for c, v in zip("rgb", (31, 41, 55), strict=True)})
point("canonicalise", "event", P.canonicalise, **{c: f"CASE WHEN a=0 THEN 0 ELSE {c} END" for c in "rgb"})
point("alpha_hard", "event", lambda d: P.hard_alpha(d, 128), a="CASE WHEN a>=128 THEN 255 ELSE 0 END")
_WHITE = "(255-r)*(255-r)+(255-g)*(255-g)+(255-b)*(255-b)"
_ERASED = f"erased AS (SELECT image_id, x, y, r, g, b, CASE WHEN {_WHITE}<=pow(0.12,2)*195075 THEN 0 ELSE a END AS a FROM src)"
add("chromakey_global_scene", on("scene", lambda d: P.chromakey_global(d, "#ffffff", 12), digested=True), src("scene", _ERASED) + digest_sql("erased"))
add("chromakey_removed_scene", on("scene", lambda d: A.removed_count(d, P.chromakey_global(d, "#ffffff", 12))), src("scene") + f"SELECT image_id, count(*) FILTER (a<>0 AND {_WHITE}<=pow(0.12,2)*195075) AS removed FROM src GROUP BY image_id")

# -- aggregates --------------------------------------------------------------------------------------------------------

add("alpha_stats_event", on("event", A.alpha_stats), src("event") + "SELECT image_id, count(*) AS total_pixels, count(*) FILTER (a=255) AS fully_opaque, count(*) FILTER (a=0) AS fully_transparent, count(*) FILTER (a NOT IN (0,255)) AS semi_transparent, count(*) FILTER (a NOT IN (0,255))/count(*)*100 AS semi_transparent_pct FROM src GROUP BY image_id")
_BG = """bins AS (SELECT image_id, CAST(r AS INTEGER)//8*1024+CAST(g AS INTEGER)//8*32+CAST(b AS INTEGER)//8 AS bin, count(*) AS n, min(y*10000+x) AS pos FROM src WHERE a>=128 GROUP BY ALL),
 best AS (SELECT image_id, bin FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, pos) AS k FROM bins) WHERE k=1),
 col AS (SELECT i.image_id, coalesce(bin,0)//1024*8+4 AS br, coalesce(bin,0)//32%32*8+4 AS bg, coalesce(bin,0)%32*8+4 AS bb FROM (SELECT DISTINCT image_id FROM src) i LEFT JOIN best USING (image_id)),
 bgc AS (SELECT image_id, lower(printf('#%02x%02x%02x', CAST(br AS INTEGER), CAST(bg AS INTEGER), CAST(bb AS INTEGER))) AS color, avg(d) FILTER (d<=30) AS noise FROM
   (SELECT image_id, br, bg, bb, (abs(r-br)+abs(g-bg)+abs(b-bb))/3 AS d FROM src JOIN col USING (image_id)) GROUP BY image_id, br, bg, bb)"""
for _f in ("scene", "embed", "event"):
    add(f"analyze_background_{_f}", on(_f, lambda d: A.analyze_background(d).select("image_id", "color", F.round("noise", 6).alias("noise"))), src(_f, _BG) + "SELECT image_id, color, round(coalesce(noise,0),6) AS noise FROM bgc")
_TYPE = f"""s AS (SELECT *, abs(lead(r) OVER w-r)+abs(lead(g) OVER w-g)+abs(lead(b) OVER w-b) AS e, least(31, CAST(floor({_LUMA6}) AS INTEGER)//8) AS lum FROM src WINDOW w AS (PARTITION BY image_id, y ORDER BY x)),
 m AS (SELECT image_id, count(*) AS n, count(*) FILTER (a<250) AS tr, count(DISTINCT CAST(r AS INTEGER)//8*1024+CAST(g AS INTEGER)//8*32+CAST(b AS INTEGER)//8) AS u, coalesce(avg(e),0) AS e FROM s GROUP BY image_id),
 act AS (SELECT image_id, count(*) FILTER (k>=n*0.005) AS bins FROM (SELECT image_id, lum, count(*) AS k FROM s GROUP BY ALL) JOIN m USING (image_id) GROUP BY image_id),
 t AS (SELECT *, tr/n>0.05 AS ht, (u<250 AND bins<10) OR (u<1500 AND e>80) OR (u<800 AND bins<12) AS gr FROM m JOIN act USING (image_id))"""
for _f in ("scene", "embed", "event"):
    add(f"detect_image_type_{_f}", on(_f, lambda d: A.detect_image_type(d).withColumn("confidence", F.round("confidence", 9))), src(_f, _TYPE) + """SELECT image_id, CASE WHEN ht THEN 'graphic-with-transparency' WHEN gr THEN 'graphic' ELSE 'photo' END AS type,
 round(least(1.0, abs(1500-u)/1500+CASE WHEN ht THEN 0.2 ELSE 0.0 END),9) AS confidence, ht AS has_transparency, u AS unique_colors, CASE WHEN ht THEN 'ready-to-resize' WHEN gr THEN 'remove-bg-color' ELSE 'remove-bg-ai' END AS action FROM t""")


def levels_ctes(table: str, out: str) -> str:
    parts = [f"SELECT image_id, '{c}' AS ch, {c} AS v, count(*) AS n FROM {table} GROUP BY ALL" for c in "rgb"]
    bounds = f"""{out}_h AS ({' UNION ALL '.join(parts)}), {out}_w AS (SELECT *, greatest(1, floor(sum(n) OVER (PARTITION BY image_id, ch)*0.005+0.5)) AS clip,
 sum(n) OVER (PARTITION BY image_id, ch ORDER BY v) AS up, sum(n) OVER (PARTITION BY image_id, ch ORDER BY v DESC) AS dn FROM {out}_h),
 {out}_b AS (SELECT image_id, ch, min(v) FILTER (up>=clip) AS lo, max(v) FILTER (dn>=clip) AS hi FROM {out}_w GROUP BY ALL)"""
    cols = ", ".join(f"CASE WHEN {c}b.hi>{c}b.lo THEN {st(f'(s.{c}-{c}b.lo)*(255.0/({c}b.hi-{c}b.lo))')} ELSE s.{c} END AS {c}" for c in "rgb")
    joins = " ".join(f"JOIN {out}_b {c}b ON {c}b.image_id=s.image_id AND {c}b.ch='{c}'" for c in "rgb")
    return f"{bounds}, {out} AS (SELECT s.image_id, s.x, s.y, {cols}, s.a FROM {table} s {joins})"


add("auto_levels_embed", on("embed", A.auto_levels), src("embed", levels_ctes("src", "lv")) + f"SELECT {PIX} FROM lv")
add("level_bounds_event", on("event", A.level_bounds), src("event", levels_ctes("src", "lv")) + "SELECT image_id, ch AS channel, lo, hi FROM lv_b")


def _white_strip(d: DataFrame) -> DataFrame:
    """scene with its white erased and a strip of the design too: the current image of a repair."""
    white = C.dist_sq("#ffffff") == 0
    return d.withColumn("a", F.when(white | ((F.col("x") + F.col("y")) % 13 == 0), 0).otherwise(F.col("a")))


_CUR = f"cur AS (SELECT image_id, x, y, r, g, b, CASE WHEN {_WHITE}=0 OR (x+y)%13=0 THEN 0 ELSE a END AS a FROM src)"
_GONE = "s.a>=32 AND c.a<32"
_AUDIT = _CUR + f""", aud AS (SELECT image_id, count(*) FILTER ({_GONE}) AS total_erased, count(*) FILTER ({_GONE} AND (x<64*0.05 OR x>=64*(1-0.05) OR y<64*0.10 OR y>=64*(1-0.10))) AS edge_erased, count(*) AS area
 FROM src s JOIN cur c USING (image_id, x, y) GROUP BY image_id)"""
add("erase_audit_scene", on("scene", lambda d: A.erase_audit(d, _white_strip(d))), src("scene", _AUDIT) + "SELECT *, edge_erased/area AS edge_frac, total_erased/area AS total_frac FROM aud")
add("audit_top_scene", on("scene", lambda d: A.audit_top(A.erase_audit(d, _white_strip(d)), "edge_frac", 15)), src("scene", _AUDIT) + "SELECT *, edge_erased/area AS edge_frac, total_erased/area AS total_frac FROM aud ORDER BY edge_frac DESC, image_id LIMIT 15")
add("leakage_scene", on("scene", lambda d: A.leakage(d, _white_strip(d))), src("scene", _CUR) + f"""SELECT image_id, count(*) FILTER (gone AND d<=30) AS removed_bg, count(*) FILTER (gone AND d>30 AND d<=80) AS removed_aa, count(*) FILTER (gone AND d>80 AND d<=150) AS leaked_light,
 count(*) FILTER (gone AND d>150) AS leaked_deep, count(*) FILTER (d>30) AS design_pixels, CASE WHEN count(*) FILTER (d>30)=0 THEN 0.0 ELSE count(*) FILTER (d>30 AND NOT gone)/count(*) FILTER (d>30) END AS preserved
 FROM (SELECT image_id, sqrt({_WHITE.replace('r', 's.r').replace('g', 's.g').replace('b', 's.b')}) AS d, c.a<128 AS gone FROM src s JOIN cur c USING (image_id, x, y)) GROUP BY image_id""")

_REGIONS = [("top", 0, 0, 63, 5), ("middle", 24, 24, 40, 40), ("corner", 56, 56, 63, 63)]


def _regions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_REGIONS, "label string, x0 int, y0 int, x1 int, y1 int")


_PTS = f"""reg AS (SELECT * FROM (VALUES {', '.join(map(str, _REGIONS))}) t(label, x0, y0, x1, y1)), hit AS (SELECT image_id, label, min(y*64+x) AS p FROM src JOIN reg ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 WHERE a>=200 AND {_WHITE}<200 GROUP BY ALL),
 pts AS (SELECT i.image_id, reg.label, CAST(coalesce(p%64,0) AS INTEGER) AS x, CAST(coalesce(p//64,0) AS INTEGER) AS y FROM (SELECT DISTINCT image_id FROM src) i CROSS JOIN reg LEFT JOIN hit ON hit.image_id=i.image_id AND hit.label=reg.label)"""
add("calibrate_sample_points_scene", lambda s, d: A.sample_points(raster(s, d, "scene"), _regions(s)), src("scene", _PTS) + "SELECT image_id, label, x, y FROM pts")
add("sample_alpha_scene", lambda s, d: A.sample_alpha(_white_strip(raster(s, d, "scene")), A.sample_points(raster(s, d, "scene"), _regions(s))), src("scene", _CUR + ", " + _PTS) + "SELECT image_id, label, a FROM pts JOIN cur USING (image_id, x, y)")

# -- windows -------------------------------------------------------------------------------------------------------------


def sep_sql(table: str, col: str, r: int, fn: str, out: str, extra: str = "") -> str:
    keep = "image_id, x, y" + extra
    return (
        f"{out}_h AS (SELECT {keep}, {fn}({col}) OVER (PARTITION BY image_id, y ORDER BY x ROWS BETWEEN {r} PRECEDING AND {r} FOLLOWING) AS v FROM {table}), "
        f"{out} AS (SELECT {keep}, {fn}(v) OVER (PARTITION BY image_id, x ORDER BY y ROWS BETWEEN {r} PRECEDING AND {r} FOLLOWING) AS v FROM {out}_h)"
    )


for _n, _op, _fn in (("erode_alpha", N.erode_alpha, "min"), ("dilate_alpha", N.dilate_alpha, "max")):
    add(f"{_n}_event", on("event", lambda d, op=_op: op(d, 2).select(*PIX.split(", "))), src("event", sep_sql("src", "a", 2, _fn, "m", ", r, g, b")) + "SELECT image_id, x, y, r, g, b, v AS a FROM m")
add("alpha_threshold_event", on("event", lambda d: N.alpha_threshold(d, 128, 1).select(*PIX.split(", "))), src("event", sep_sql("src", "a", 1, "min", "m", ", r, g, b")) + "SELECT image_id, x, y, r, g, b, CASE WHEN v>=128 THEN 255 ELSE 0 END AS a FROM m")


def _bright(d: DataFrame) -> DataFrame:
    return d.select("image_id", "x", "y", (F.col("g") >= 60).cast("int").alias("m"))


_MASK = "msk AS (SELECT image_id, x, y, CAST(g>=60 AS INTEGER) AS m FROM src)"
add("dilate_binary_mask_event", on("event", lambda d: N.dilate_mask(_bright(d), 1)), src("event", _MASK + ", " + sep_sql("msk", "m", 1, "max", "o")) + "SELECT image_id, x, y, v AS m FROM o")
_CROSS = "(SELECT * FROM (VALUES (1,0),(-1,0),(0,1),(0,-1)) t(dx,dy))"
add("erode_mask4_event", on("event", lambda d: N.erode_mask4(_bright(d)).select("image_id", "x", "y", "m")), src("event", _MASK) + f"SELECT k.image_id, k.x, k.y, CAST(k.m=1 AND n.n=4 AS INTEGER) AS m FROM msk k LEFT JOIN (SELECT a.image_id, a.x, a.y, sum(b.m) AS n FROM msk a CROSS JOIN {_CROSS} o JOIN msk b ON b.image_id=a.image_id AND b.x=a.x+o.dx AND b.y=a.y+o.dy GROUP BY ALL) n USING (image_id, x, y)")
add("dilate_mask4_event", on("event", lambda d: N.dilate_mask4(_bright(d), 2).select("image_id", "x", "y", "m")), src("event", _MASK) + "SELECT a.image_id, a.x, a.y, CAST(max(b.m) AS INTEGER) AS m FROM msk a JOIN msk b ON a.image_id=b.image_id AND abs(a.x-b.x)+abs(a.y-b.y)<=2 GROUP BY a.image_id, a.x, a.y")
add("feather_alpha_event", on("event", lambda d: N.feather_alpha(d, 2).select("image_id", "x", "y", "a")), src("event", "o AS (SELECT i-2 AS dx, j-2 AS dy FROM range(5) a(i), range(5) b(j))") + "SELECT s.image_id, s.x, s.y, CAST(floor(avg(t.a)+0.5) AS INTEGER) AS a FROM src s CROSS JOIN o JOIN src t ON t.image_id=s.image_id AND t.x=least(15, greatest(0, s.x+dx)) AND t.y=least(15, greatest(0, s.y+dy)) GROUP BY s.image_id, s.x, s.y")


def sharpen_ctes(table: str, out: str, amount: float) -> str:
    def side(c: str) -> str:
        return "+".join(f"coalesce({f}({c}) OVER {w},{c})" for f in ("lag", "lead") for w in ("wx", "wy"))

    cols = ", ".join(f"{st(f'{c}*(1+4*{amount})-({side(c)})*{amount}')} AS {c}" for c in "rgb")
    return f"{out} AS (SELECT image_id, x, y, {cols}, a FROM {table} WINDOW wx AS (PARTITION BY image_id, y ORDER BY x), wy AS (PARTITION BY image_id, x ORDER BY y))"


add("sharpen_embed", on("embed", lambda d: N.sharpen(d, 0.25)), src("embed", sharpen_ctes("src", "o", 0.25)) + f"SELECT {PIX} FROM o")
_K5 = [[1, 2, 3, 2, 1], [2, 4, 6, 4, 2], [3, 6, 9, 6, 3], [2, 4, 6, 4, 2], [1, 2, 3, 2, 1]]
_K5 = [[v / 128 for v in row] for row in _K5]
add("convolution_event", on("event", lambda d: N.convolve(d, _K5)), src("event", "o AS (SELECT * FROM (VALUES " + ", ".join(f"({i - 2},{j - 2},{_K5[j][i]})" for j in range(5) for i in range(5)) + ") t(dx,dy,k))")
    + "SELECT s.image_id, s.x, s.y, " + ", ".join(f"{st(f'sum(t.{c}*CAST(k AS DOUBLE))')} AS {c}" for c in "rgb") + ", any_value(s.a) AS a FROM src s CROSS JOIN o JOIN src t ON t.image_id=s.image_id AND t.x=least(15, greatest(0, s.x+dx)) AND t.y=least(15, greatest(0, s.y+dy)) GROUP BY s.image_id, s.x, s.y")


def sobel_ctes(table: str) -> str:
    return f"""lum AS (SELECT *, {_LUMA6} AS l FROM {table}), so AS (SELECT * FROM (VALUES (-1,-1,-1,-1),(0,-1,0,-2),(1,-1,1,-1),(-1,0,-2,0),(1,0,2,0),(-1,1,-1,1),(0,1,0,2),(1,1,1,1)) t(dx,dy,kx,ky)),
 gr AS (SELECT s.image_id, s.x, s.y, CASE WHEN count(*)=8 THEN sqrt(pow(sum(kx*n.l),2)+pow(sum(ky*n.l),2)) ELSE 0 END AS g FROM lum s CROSS JOIN so JOIN lum n ON n.image_id=s.image_id AND n.x=s.x+dx AND n.y=s.y+dy GROUP BY s.image_id, s.x, s.y),
 gm AS (SELECT *, max(g) OVER (PARTITION BY image_id) AS top FROM gr)"""


for _f in ("embed", "event"):
    add(f"edge_map_{_f}", on(_f, lambda d: N.edge_map(d).withColumn("cost", F.round("cost", 6))), src(_f, sobel_ctes("src")) + "SELECT image_id, x, y, round(CASE WHEN top=0 THEN 1.0 ELSE greatest(0.05, 1-sqrt(g/top)) END, 6) AS cost FROM gm")
_TAP = "exp(-(k*k)/(2*1.2*1.2))"


def edge_sharpen_ctes(table: str, out: str, amount: float) -> str:
    def blur(prev: str, at: str) -> str:
        other = "n.y=s.y" if at == "x" else "n.x=s.x"
        cols = ", ".join(f"sum(n.{c}*{_TAP})/sum({_TAP}) AS {c}" for c in "rgb")
        return f"SELECT s.image_id, s.x, s.y, {cols} FROM {prev} s CROSS JOIN taps JOIN {prev} n ON n.image_id=s.image_id AND {other} AND n.{at}=s.{at}+k GROUP BY s.image_id, s.x, s.y"

    new = ", ".join(st(f"round(s.{c}+bo.k*(s.{c}-bv.{c}),6)") + f" AS {c}" for c in "rgb")
    return f"""{sobel_ctes(table)}, taps AS (SELECT k-3 AS k FROM range(7) t(k)), bh AS ({blur(table, 'x')}), bv AS ({blur('bh', 'y')}),
 bo AS (SELECT *, CASE WHEN e<=0.08 THEN 0.0 WHEN e>=0.16 THEN 1.0 ELSE ((e-0.08)/0.08)*((e-0.08)/0.08)*(3-2*((e-0.08)/0.08)) END*{amount} AS k FROM (SELECT image_id, x, y, CASE WHEN top>0 THEN g/top ELSE 0 END AS e FROM gm)),
 {out} AS (SELECT s.image_id, s.x, s.y, {new}, s.a FROM {table} s JOIN bv USING (image_id, x, y) JOIN bo USING (image_id, x, y))"""


add("edge_aware_sharpen_event", on("event", lambda d: N.edge_aware_sharpen(d)), src("event", edge_sharpen_ctes("src", "es", 0.5)) + f"SELECT {PIX} FROM es")
_BGT = f"{_WHITE}<=pow(0.05,2)*195075"
add("thicken_scene", on("scene", lambda d: N.thicken_lines(d, "#ffffff", 5), digested=True), src("scene", f"""k AS (SELECT *, a<>0 AND {_BGT} AS bg, {_WHITE} AS d FROM src),
 o AS (SELECT * FROM (VALUES (0,-1,-1),(1,0,-1),(2,1,-1),(3,-1,0),(4,1,0),(5,-1,1),(6,0,1),(7,1,1)) t(i,dx,dy)),
 best AS (SELECT image_id, x, y, arg_max({{'r': nr, 'g': ng, 'b': nb}}, d*8-i) AS v FROM (SELECT s.image_id, s.x, s.y, n.r AS nr, n.g AS ng, n.b AS nb, n.d, o.i FROM k s CROSS JOIN o JOIN k n ON n.image_id=s.image_id AND n.x=s.x+dx AND n.y=s.y+dy WHERE s.bg AND NOT n.bg AND n.a<>0) GROUP BY ALL),
 res AS (SELECT image_id, x, y, coalesce(v.r, k.r) AS r, coalesce(v.g, k.g) AS g, coalesce(v.b, k.b) AS b, CASE WHEN v IS NULL THEN a ELSE 255 END AS a FROM k LEFT JOIN best USING (image_id, x, y))""") + digest_sql("res"))


def decon_ctes(table: str, out: str, drop: float, ground: tuple[str, str, str] = ("255", "255", "255")) -> str:
    """One round of edge decontamination against a ground colour, inner radius 3."""
    kr, kg, kb = ground
    return f"""{out}_f AS (SELECT *, a=255 AS o, a=255 AND least(coalesce(lag(a) OVER wx,255), coalesce(lead(a) OVER wx,255), coalesce(lag(a) OVER wy,255), coalesce(lead(a) OVER wy,255))<>255 AS fr FROM {table} WINDOW wx AS (PARTITION BY image_id, y ORDER BY x), wy AS (PARTITION BY image_id, x ORDER BY y)),
 {out}_o AS (SELECT i-3 AS dx, j-3 AS dy FROM range(7) p(i), range(7) q(j)),
 {out}_m AS (SELECT s.image_id, s.x, s.y, sum(n.r)/count(*) AS fr_, sum(n.g)/count(*) AS fg_, sum(n.b)/count(*) AS fb_ FROM {out}_f s CROSS JOIN {out}_o JOIN {out}_f n ON n.image_id=s.image_id AND n.x=s.x+dx AND n.y=s.y+dy WHERE s.fr AND n.o AND NOT n.fr GROUP BY s.image_id, s.x, s.y),
 {out}_t AS (SELECT *, pow(fr_-{kr},2)+pow(fg_-{kg},2)+pow(fb_-{kb},2) AS den FROM {out}_f LEFT JOIN {out}_m USING (image_id, x, y)),
 {out}_u AS (SELECT *, CASE WHEN den>=8 THEN least(1.0, greatest(0.0, ((r-{kr})*(fr_-{kr})+(g-{kg})*(fg_-{kg})+(b-{kb})*(fb_-{kb}))/den)) END AS t FROM {out}_t),
 {out} AS (SELECT image_id, x, y, CASE WHEN t>={drop} THEN CAST(floor(fr_+0.5) AS INTEGER) ELSE r END AS r, CASE WHEN t>={drop} THEN CAST(floor(fg_+0.5) AS INTEGER) ELSE g END AS g, CASE WHEN t>={drop} THEN CAST(floor(fb_+0.5) AS INTEGER) ELSE b END AS b, CASE WHEN t<{drop} THEN 0 ELSE a END AS a FROM {out}_u)"""


add("decontaminate_scene", on("scene", lambda d: N.decontaminate_edges(P.chromakey_global(d, "#ffffff", 12), "#ffffff", 0.35, 1), digested=True), src("scene", _ERASED + ", " + decon_ctes("erased", "dc", 0.35)) + digest_sql("dc"))
_E3 = f"e3 AS (SELECT image_id, x, y, r, g, b, CASE WHEN a<>0 AND {_WHITE}<=pow(0.03,2)*195075 THEN 0 ELSE a END AS a FROM src)"
add("remove_color_global_scene", on("scene", lambda d: N.remove_color_global(d, "#ffffff", 3), digested=True), src("scene", _E3 + ", " + decon_ctes("e3", "dc", 0.4)) + digest_sql("dc"))
_PAD = """pad AS (SELECT i.image_id, xx.v AS x, yy.v AS y, coalesce(s.r,0) AS r, coalesce(s.g,0) AS g, coalesce(s.b,0) AS b, coalesce(s.a,0) AS a FROM (SELECT DISTINCT image_id FROM src) i CROSS JOIN range(20) xx(v) CROSS JOIN range(20) yy(v) LEFT JOIN src s ON s.image_id=i.image_id AND s.x=xx.v-2 AND s.y=yy.v-2)"""
_OA = "(a/255+v/255*(1-a/255))"
add("outline_event", on("event", lambda d: N.outline(d, 2, "#1f2937")), src("event", _PAD + ", " + sep_sql("pad", "a", 2, "max", "m", ", r, g, b, a"))
    + "SELECT image_id, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, " + ", ".join(f"CASE WHEN {_OA}=0 THEN 0 ELSE {st(f'({c}*(a/255)+{k}*(v/255)*(1-a/255))/{_OA}')} END AS {c}" for c, k in zip("rgb", (31, 41, 55), strict=True)) + f", {st(f'{_OA}*255')} AS a FROM m")


def _restore(spark: SparkSession, sf: str, mode: str) -> DataFrame:
    d = raster(spark, sf, "scene")
    colour = "#ffffff" if mode == "solid" else "#8080c0"
    out = N.restore_color(_white_strip(d), d, colour, 26 if mode == "solid" else 40, 1, 5, mode)
    return out.groupBy("image_id").agg(F.count_if("restored").alias("restored"), F.sum(F.expr(LONG_KEY).cast("long")).alias("checksum"))


def restore_ctes(colour: tuple[int, int, int], tol: float, mode: str, original: str = "src", search: int = 5) -> str:
    """``res``: cur with what is near of the original's places of a colour, grown by one, brought back."""
    d = "+".join(f"(s.{c}-{v})*(s.{c}-{v})" for c, v in zip("rgb", colour, strict=True))
    new = ", ".join(f"CASE WHEN f.v=1 AND c.a<>255 THEN {v if mode == 'solid' else f's.{c}'} ELSE c.{c} END AS {c}" for c, v in zip("rgb", colour, strict=True))
    return ("vis AS (SELECT image_id, x, y, CAST(a>0 AS INTEGER) AS m FROM cur), " + sep_sql("vis", "m", search, "max", "al")
        + f", hit AS (SELECT s.image_id, s.x, s.y, CAST(al.v=1 AND c.a<>255 AND {d}<=pow({tol},2)*195075 AS INTEGER) AS m FROM {original} s JOIN cur c USING (image_id, x, y) JOIN al USING (image_id, x, y)), " + sep_sql("hit", "m", 1, "max", "f")
        + f", res AS (SELECT s.image_id, s.x, s.y, f.v=1 AND c.a<>255 AS back, {new}, CASE WHEN f.v=1 AND c.a<>255 THEN 255 ELSE c.a END AS a FROM {original} s JOIN cur c USING (image_id, x, y) JOIN f USING (image_id, x, y))")


def restore_sql(colour: tuple[int, int, int], tol: float, mode: str) -> str:
    return src("scene", _CUR + ", " + restore_ctes(colour, tol, mode)) + f"SELECT image_id, count(*) FILTER (back) AS restored, CAST(sum({KEY}) AS BIGINT) AS checksum FROM res GROUP BY image_id"


add("restore_color_scene", lambda s, d: _restore(s, d, "solid"), restore_sql((255, 255, 255), 0.26, "solid"))
add("restore_color_original_scene", lambda s, d: _restore(s, d, "original"), restore_sql((128, 128, 192), 0.40, "original"))

# -- geometry --------------------------------------------------------------------------------------------------------------

for _n, _op, _x, _y in (
    ("mirror_horizontal", G.mirror_horizontal, "15-x", "y"), ("mirror_vertical", G.mirror_vertical, "x", "15-y"), ("rotate90", lambda d: G.rotate_ortho(d, 90), "15-y", "x"),
    ("rotate180", lambda d: G.rotate_ortho(d, 180), "15-x", "15-y"), ("rotate270", lambda d: G.rotate_ortho(d, 270), "y", "15-x"),
):
    add(f"{_n}_event", on("event", _op), src("event") + f"SELECT image_id, CAST({_x} AS INTEGER) AS x, CAST({_y} AS INTEGER) AS y, r, g, b, a FROM src")
add("crop_to_box_scene", on("scene", lambda d: G.crop_to_box(d, 10, 12, 30, 20), digested=True), src("scene", "c AS (SELECT image_id, x-10 AS x, y-12 AS y, r, g, b, a FROM src WHERE x BETWEEN 10 AND 39 AND y BETWEEN 12 AND 31)") + digest_sql("c"))
add("auto_crop_event", on("event", lambda d: G.auto_crop(d.withColumn("a", F.when((F.col("image_id") % 5 == 0) | ~F.col("x").between(3, 11) | ~F.col("y").between(4, 13), 0).otherwise(F.col("a"))), 1, 1)),
    src("event", """e AS (SELECT image_id, x, y, r, g, b, CASE WHEN image_id%5=0 OR x NOT BETWEEN 3 AND 11 OR y NOT BETWEEN 4 AND 13 THEN 0 ELSE a END AS a FROM src),
 b AS (SELECT image_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM e WHERE a>=1 GROUP BY image_id)""")
    + """SELECT image_id, CAST(x-greatest(0,x0-1) AS INTEGER) AS x, CAST(y-greatest(0,y0-1) AS INTEGER) AS y, r, g, b, a FROM e JOIN b USING (image_id) WHERE x BETWEEN greatest(0,x0-1) AND least(15,x1+1) AND y BETWEEN greatest(0,y0-1) AND least(15,y1+1)
 UNION ALL SELECT image_id, 0, 0, 0, 0, 0, 0 FROM (SELECT DISTINCT image_id FROM e WHERE image_id NOT IN (SELECT image_id FROM b))""")  # fmt: skip


def resample_ctes(table: str, n: int, m: int, name: str, out: str = "rs") -> str:
    """``out``: the square raster ``table`` of side n at side m, as bytes."""
    spread = max(1.0, n / m)
    radius = C.FILTER_RADIUS[name] * spread
    w = f"""wt0 AS (SELECT j, k, CAST({filter_sql(f'((k-c)/{spread})', name)} AS DOUBLE) AS w FROM (SELECT CAST(j AS INTEGER) AS j, (j+0.5)*{n / m}-0.5 AS c, unnest(range(CAST(greatest(0, floor((j+0.5)*{n / m}-0.5-{radius})) AS BIGINT), CAST(least({n - 1}, ceil((j+0.5)*{n / m}-0.5+{radius})) AS BIGINT)+1)) AS k FROM range({m}) t(j))),
 wt AS (SELECT j, k, w/sum(w) OVER (PARTITION BY j) AS w FROM wt0)"""
    h = f"h AS (SELECT image_id, j AS x, y, {', '.join(f'sum({c}*(a/255)*w) AS {c}' for c in 'rgb')}, sum(a*w) AS a FROM {table} JOIN wt ON k=x GROUP BY image_id, j, y)"
    v = f"v AS (SELECT image_id, x, j AS y, {', '.join(f'sum({c}*w) AS {c}' for c in 'rgba')} FROM h JOIN wt ON k=y GROUP BY image_id, x, j)"
    stored = ", ".join("CASE WHEN a<=0 THEN 0 ELSE " + st(f"round({c}*(255/a),6)") + f" END AS {c}" for c in "rgb")
    return f"{w}, {h}, {v}, {out} AS (SELECT image_id, x, y, {stored}, CASE WHEN a<=0 THEN 0 ELSE {st('round(a,6)')} END AS a FROM v)"


def resample_sql(fixture: str, n: int, m: int, name: str) -> str:
    return src(fixture, resample_ctes("src", n, m, name)) + f"SELECT {PIX} FROM rs"


for _f, _n, _m, _k in (("embed", 64, 96, "lanczos3"), ("event", 16, 10, "lanczos3"), ("event", 16, 40, "bicubic"), ("event", 16, 7, "bilinear"), ("event", 16, 24, "lanczos2")):
    add(f"resample_{_k}_{_f}" + (f"_{_m}" if (_f, _k) == ("event", "lanczos3") else ""), on(_f, lambda d, n=_n, m=_m, k=_k: G.resample(d, (n, n), (m, m), k)), resample_sql(_f, _n, _m, _k))
add("resample_weights", lambda s, d: G.weight_table(s, 64, 96).select("j", "k", F.round("wt", 9).alias("wt")), resample_sql("embed", 64, 96, "lanczos3").replace(f"src AS MATERIALIZED ({SQL['embed']}), ", "").split(", h AS (")[0] + " SELECT j, CAST(k AS INTEGER) AS k, round(w, 9) AS wt FROM wt")
add("halve_event", on("event", G.halve), src("event") + f"SELECT image_id, CAST(x//2 AS INTEGER) AS x, CAST(y//2 AS INTEGER) AS y, {', '.join(f'CASE WHEN sum(a)=0 THEN 0 ELSE ' + st(f'sum({c}*a)/sum(a)') + f' END AS {c}' for c in 'rgb')}, {st('avg(a)')} AS a FROM src GROUP BY image_id, x//2, y//2".replace("x//2", "(CAST(x AS INTEGER)//2)").replace("y//2", "(CAST(y AS INTEGER)//2)"))


def _parts(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("image_id"), (F.col("p_size") * 40).alias("width"), (F.col("p_partkey") % 900 + 100).cast("int").alias("height"))


_SIZES = "sizes AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', CAST({w} AS DOUBLE), CAST({h} AS DOUBLE))" for a, w, h in L.COMMON_PRINT_SIZES) + ") t(label, wi, hi))"
add("print_dims_part", lambda s, d: G.print_dims(_parts(s, d), L.print_sizes(s), 300.0).withColumn("source_dpi", F.round("source_dpi", 6)), f"""WITH {_SIZES}, p AS (SELECT p_partkey AS image_id, p_size*40 AS w, p_partkey%900+100 AS h FROM part)
SELECT image_id, label, CAST(CASE WHEN wi=0 THEN w WHEN w/h>=wi/hi THEN floor(wi*300+0.5) ELSE floor(floor(hi*300+0.5)*(w/h)+0.5) END AS BIGINT) AS out_w,
 CAST(CASE WHEN wi=0 THEN h WHEN w/h>=wi/hi THEN floor(floor(wi*300+0.5)/(w/h)+0.5) ELSE floor(hi*300+0.5) END AS BIGINT) AS out_h,
 round(CASE WHEN wi=0 THEN NULL WHEN w/h>=wi/hi THEN w/wi ELSE h/hi END, 6) AS source_dpi FROM p CROSS JOIN sizes""")


def _polygons(spark: SparkSession, sf: str) -> DataFrame:
    p = spark.read.parquet(f"{sf}/part.parquet")
    pts = F.array(*[F.struct(((F.col("p_partkey") * a + b) % 64).cast("int").alias("x"), ((F.col("p_partkey") * c + d) % 64).cast("int").alias("y")) for a, b, c, d in _VERTICES])
    return p.select(F.col("p_partkey").alias("poly_id"), F.when(F.col("p_partkey") % 7 == 0, F.slice(pts, 1, 2)).when(F.col("p_partkey") % 2 == 0, F.slice(pts, 1, 3)).otherwise(pts).alias("points"))


_VERTICES = [(37, 3, 53, 11), (29, 40, 17, 5), (11, 60, 43, 50), (53, 9, 31, 33), (23, 25, 61, 2)]
_POLY = f"""WITH p AS (SELECT p_partkey AS id, CASE WHEN p_partkey%7=0 THEN 2 WHEN p_partkey%2=0 THEN 3 ELSE 5 END AS n FROM part),
 v AS (SELECT * FROM (VALUES {', '.join(f'({i},{a},{b},{c},{d})' for i, (a, b, c, d) in enumerate(_VERTICES))}) t(i,a,b,c,d)),
 pt AS (SELECT id, n, i, CAST((id*a+b)%64 AS DOUBLE) AS x, CAST((id*c+d)%64 AS DOUBLE) AS y FROM p JOIN v ON i<n WHERE n>=3),
 e AS (SELECT s.id, s.x AS x1, s.y AS y1, t.x AS x2, t.y AS y2 FROM pt s JOIN pt t ON t.id=s.id AND t.i=(s.i+1)%s.n),
 c AS (SELECT id, y, x1+(y-y1)/(y2-y1)*(x2-x1) AS cx FROM e JOIN range(64) r(y) ON (y1<=y AND y2>y) OR (y2<=y AND y1>y)),
 k AS (SELECT *, row_number() OVER w AS n, lead(cx) OVER w AS cy FROM c WINDOW w AS (PARTITION BY id, y ORDER BY cx))
SELECT DISTINCT id AS poly_id, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y FROM k JOIN range(64) q(x) ON x>=ceil(cx) AND x<=floor(cy) WHERE n%2=1"""
add("polygon_mask_part", lambda s, d: G.polygon_mask(_polygons(s, d), 64, 64).groupBy("poly_id").agg(F.count("*").alias("n"), F.sum((F.col("y") * 64 + F.col("x")).cast("long")).alias("places")), _POLY.replace("SELECT DISTINCT id AS poly_id", ", m AS (SELECT DISTINCT id AS poly_id") + ") SELECT poly_id, count(*) AS n, CAST(sum(y*64+x) AS BIGINT) AS places FROM m GROUP BY poly_id")

# -- masks -------------------------------------------------------------------------------------------------------------------


def _two_masks(d: DataFrame) -> tuple[DataFrame, DataFrame]:
    return d.where("g >= 60").select("image_id", "x", "y"), d.where("r >= 100").select("image_id", "x", "y")


for _n, _op, _w in (("mask_and", R.mask_and, "g>=60 AND r>=100"), ("mask_or", R.mask_or, "g>=60 OR r>=100"), ("mask_except", R.mask_except, "g>=60 AND NOT r>=100")):
    add(f"{_n}_event", on("event", lambda d, op=_op: op(*_two_masks(d))), src("event") + f"SELECT image_id, x, y FROM src WHERE {_w}")
add("mask_invert_event", on("event", lambda d: R.mask_invert(_bright(d))), src("event") + "SELECT image_id, x, y, CAST(NOT g>=60 AS INTEGER) AS m FROM src")
add("mask_clear_event", on("event", lambda d: R.mask_clear(_bright(d))), src("event") + "SELECT image_id, x, y, CAST(1 AS INTEGER) AS m FROM src")
for _k in ("inside", "outside"):
    add(f"apply_mask_{_k}_event", on("event", lambda d, k=_k: P.apply_mask(d, _bright(d), k).select(*PIX.split(", "))), src("event") + f"SELECT image_id, x, y, r, g, b, CASE WHEN (g>=60)={'false' if _k == 'inside' else 'true'} THEN 0 ELSE a END AS a FROM src")
_STROKES = [(0, 4, 4, 6.0, 0), (1, 8, 8, 9.0, 1), (2, 6, 5, 3.0, 0)]
add("paint_event", lambda s, d: R.paint(_bright(raster(s, d, "event")), s.createDataFrame(_STROKES, "seq int, x int, y int, size double, value int")), src("event", f"k AS (SELECT * FROM (VALUES {', '.join(map(str, _STROKES))}) t(seq,cx,cy,size,value))")
    + "SELECT s.image_id, s.x, s.y, CAST(coalesce(arg_max(k.value, k.seq), any_value(CAST(s.g>=60 AS INTEGER))) AS INTEGER) AS m FROM src s LEFT JOIN k ON (s.x-cx)*(s.x-cx)+(s.y-cy)*(s.y-cy)<=size*size/4 GROUP BY s.image_id, s.x, s.y")

# -- graph -------------------------------------------------------------------------------------------------------------------

_STEP = "JOIN (SELECT * FROM (VALUES (1,0),(-1,0),(0,1),(0,-1)) t(dx,dy)) o ON true"


def flood_ctes(member: str, out: str, table: str = "src", side: int = 63) -> str:
    return (
        f"{out}_m AS MATERIALIZED (SELECT image_id, x, y FROM {table} WHERE {member}), "
        f"{out} AS (SELECT image_id, x, y FROM {out}_m WHERE x IN (0,{side}) OR y IN (0,{side}) UNION SELECT m.image_id, m.x, m.y FROM {out} f {_STEP} JOIN {out}_m m ON m.image_id=f.image_id AND m.x=f.x+o.dx AND m.y=f.y+o.dy)"
    )


def labels_ctes(member: str, out: str, table: str = "src", width: int = 64) -> str:
    """Labels by spreading from every member: the least raster index that reaches a place."""
    return (
        f"{out}_m AS MATERIALIZED (SELECT image_id, x, y FROM {table} WHERE {member}), "
        f"{out}_s AS MATERIALIZED (SELECT m.image_id, m.x, m.y FROM {out}_m m LEFT JOIN {out}_m l ON l.image_id=m.image_id AND l.x=m.x-1 AND l.y=m.y LEFT JOIN {out}_m u ON u.image_id=m.image_id AND u.x=m.x AND u.y=m.y-1 WHERE l.x IS NULL AND u.x IS NULL), "
        f"{out}_r AS (SELECT image_id, x, y, y*{width}+x AS label FROM {out}_s UNION SELECT m.image_id, m.x, m.y, f.label FROM {out}_r f {_STEP} JOIN {out}_m m ON m.image_id=f.image_id AND m.x=f.x+o.dx AND m.y=f.y+o.dy), "
        f"{out} AS (SELECT image_id, x, y, CAST(min(label) AS BIGINT) AS label FROM {out}_r GROUP BY image_id, x, y)"
    )


_W3 = f"a<>0 AND {_WHITE}<=pow(0.03,2)*195075"
_FLOODED = "res AS (SELECT s.image_id, s.x, s.y, r, g, b, CASE WHEN f.x IS NULL THEN a ELSE 0 END AS a FROM src s LEFT JOIN f ON f.image_id=s.image_id AND f.x=s.x AND f.y=s.y)"
add("flood_fill_scene", on("scene", lambda d: R.flood_fill(d, "#ffffff", 3), digested=True), src("scene", flood_ctes(_W3, "f") + ", " + _FLOODED, True) + digest_sql("res"))
add("chromakey_flood_scene", on("scene", lambda d: digest(PL.chromakey(d, "#ffffff", 12, "flood", 0))), src("scene", flood_ctes(f"a<>0 AND {_WHITE}<=pow(0.12,2)*195075", "f") + ", " + _FLOODED, True) + digest_sql("res"))
_DEPTH = f"""k AS MATERIALIZED (SELECT image_id, x, y, {_WHITE}<=pow(0.12,2)*195075 AS t FROM src WHERE a<>0 AND {_WHITE}<=pow(0.40,2)*195075),
 d AS (SELECT image_id, x, y, CASE WHEN t THEN 0 ELSE 1 END AS depth FROM k WHERE x IN (0,63) OR y IN (0,63)
  UNION SELECT k.image_id, k.x, k.y, CASE WHEN k.t THEN 0 ELSE d.depth+1 END FROM d {_STEP} JOIN k ON k.image_id=d.image_id AND k.x=d.x+o.dx AND k.y=d.y+o.dy WHERE k.t OR d.depth<3),
 f AS (SELECT image_id, x, y, min(depth) AS depth FROM d GROUP BY ALL)"""
add("depth_flood_scene", on("scene", lambda d: R.depth_flood(d, "#ffffff", 12, 40, 3).groupBy("image_id", "depth").agg(F.count("*").alias("n"))), src("scene", _DEPTH, True) + "SELECT image_id, depth, count(*) AS n FROM f GROUP BY ALL")
add("smart_erase_scene", on("scene", lambda d: R.smart_erase(d, "#ffffff", 12, 40, 3), digested=True), src("scene", _DEPTH + ", " + _FLOODED, True) + digest_sql("res"))
_HOLES = flood_ctes(_W3, "f") + ", " + _FLOODED + f""", kd AS MATERIALIZED (SELECT *, CASE WHEN a<128 THEN 0 WHEN {_WHITE}<=pow(0.03,2)*195075 THEN 2 ELSE 1 END AS kind FROM res), """ + labels_ctes("kind=2", "lb", "kd") + f""",
 rim AS (SELECT DISTINCT lb.image_id, lb.label, k.x, k.y, k.kind FROM lb {_STEP} JOIN kd k ON k.image_id=lb.image_id AND k.x=lb.x+o.dx AND k.y=lb.y+o.dy WHERE k.kind<>2),
 tr AS (SELECT image_id, x, y FROM kd WHERE kind=0),
 wall AS (SELECT image_id, label, min(CASE WHEN kind=0 THEN 0 ELSE coalesce((SELECT min(abs(t.x-rim.x)+abs(t.y-rim.y)) FROM tr t WHERE t.image_id=rim.image_id AND abs(t.x-rim.x)+abs(t.y-rim.y)<=14), 65535) END) AS wall FROM rim GROUP BY ALL)"""
add("enclosed_holes_scene", on("scene", lambda d: R.enclosed_blobs(R.flood_fill(d, "#ffffff", 3), "#ffffff", 3, 12)[1].select("image_id", "label", "size", F.col("wall").cast("long").alias("wall"), "erased")), src("scene", _HOLES, True)
    + "SELECT image_id, label, n AS size, CAST(coalesce(wall,65535) AS BIGINT) AS wall, coalesce(wall,65535) BETWEEN 1 AND 12 AS erased FROM (SELECT image_id, label, count(*) AS n FROM lb GROUP BY ALL) LEFT JOIN wall USING (image_id, label)")
add("enclosed_holes_rings", on("rings", lambda d: R.enclosed_blobs(d, "#ffffff", 3, 12)[1].select("image_id", "size", "erased")), src("rings") + "SELECT image_id, count(*) AS size, any_value(image_id<=12) AS erased FROM src WHERE r=255 AND a=255 GROUP BY image_id")


def _seeds(d: DataFrame) -> DataFrame:
    """The first white pixel of each image in raster order."""
    return d.where(C.dist_sq("#ffffff") == 0).groupBy("image_id").agg(F.min(F.struct("y", "x")).alias("s")).select("image_id", F.col("s.x").alias("sx"), F.col("s.y").alias("sy"))


_SEED = f"""sd AS (SELECT image_id, min(y*64+x) AS p FROM src WHERE {_WHITE}=0 GROUP BY image_id),
 mm AS MATERIALIZED (SELECT image_id, x, y FROM src WHERE {_WHITE}<=pow(0.12,2)*195075), sf AS (SELECT image_id, p%64 AS x, p//64 AS y FROM sd UNION SELECT m.image_id, m.x, m.y FROM sf {_STEP} JOIN mm m ON m.image_id=sf.image_id AND m.x=sf.x+o.dx AND m.y=sf.y+o.dy),
 go AS (SELECT image_id, x, y FROM sf UNION SELECT s.image_id, s.x, s.y FROM src s JOIN sf ON sf.image_id=s.image_id AND abs(sf.x-s.x)<=1 AND abs(sf.y-s.y)<=1 WHERE {_WHITE.replace('r', 's.r').replace('g', 's.g').replace('b', 's.b')}<=pow(0.24,2)*195075),
 f AS (SELECT * FROM go), {_FLOODED}"""
add("erase_region_scene", on("scene", lambda d: R.erase_region(d, _seeds(d), 12, 1), digested=True), src("scene", _SEED, True) + digest_sql("res"))
_GROW = sobel_ctes("src") + f""", cost AS (SELECT image_id, x, y, CASE WHEN top=0 THEN 1.0 ELSE greatest(0.05, 1-sqrt(g/top)) END AS c FROM gm), sd AS (SELECT image_id, min(y*64+x) AS p FROM src WHERE {_WHITE}=0 GROUP BY image_id),
 mm AS MATERIALIZED (SELECT image_id, x, y FROM src JOIN cost USING (image_id, x, y) WHERE {_WHITE}<=28*28 AND c>=1-0.55),
 sf AS (SELECT image_id, p%64 AS x, p//64 AS y FROM sd UNION SELECT m.image_id, m.x, m.y FROM sf {_STEP} JOIN mm m ON m.image_id=sf.image_id AND m.x=sf.x+o.dx AND m.y=sf.y+o.dy)"""
add("click_to_grow_scene", on("scene", lambda d: R.click_to_grow(d, _seeds(d)).groupBy("image_id").agg(F.count("*").alias("n"), F.sum(F.col("y").cast("long") * 64 + F.col("x")).alias("places"))), src("scene", _GROW, True) + "SELECT image_id, count(*) AS n, CAST(sum(y*64+x) AS BIGINT) AS places FROM sf GROUP BY image_id")
_DARK = f"{_LUMA}<90"
_CHROMA = "(greatest(r,g,b)-least(r,g,b))"
_ISSAT = f"greatest(r,g,b)>0 AND {_CHROMA}/greatest(r,g,b)>0.18"
_HUE = f"(CASE WHEN greatest(r,g,b)=r THEN (g-b)/{_CHROMA} WHEN greatest(r,g,b)=g THEN (b-r)/{_CHROMA}+2 ELSE (r-g)/{_CHROMA}+4 END)*pi()/3"
_FEAT = labels_ctes(_DARK, "lb") + f""", ft AS (SELECT image_id, label, count(*) AS count, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y, avg(r) AS mean_r, avg(g) AS mean_g, avg(b) AS mean_b, (stddev_pop(r)+stddev_pop(g)+stddev_pop(b))/3 AS colour_variance,
 count(*) FILTER ({_ISSAT}) AS st, avg(cos(2*{_HUE})) FILTER ({_ISSAT}) AS c, avg(sin(2*{_HUE})) FILTER ({_ISSAT}) AS s FROM lb JOIN src USING (image_id, x, y) GROUP BY ALL)"""
_FCOLS = ["mean_r", "mean_g", "mean_b", "colour_variance", "hue_incoherence", "saturated_frac", "fill_ratio"]


def _features(d: DataFrame) -> DataFrame:
    f = R.component_features(d, K.label_components(d, C.luma709() < 90))
    return f.withColumns({c: F.round(c, 6) + 0.0 for c in _FCOLS})


add("component_features_scene", on("scene", _features), src("scene", _FEAT, True) + """SELECT image_id, label, count, min_x, min_y, max_x, max_y, round(mean_r,6) AS mean_r, round(mean_g,6) AS mean_g, round(mean_b,6) AS mean_b, round(colour_variance,6) AS colour_variance,
 round(CASE WHEN st>=12 THEN 1-sqrt(c*c+s*s) END,6)+0.0 AS hue_incoherence, round(st/count,6) AS saturated_frac, round(count/((max_x-min_x+1)*(max_y-min_y+1)),6) AS fill_ratio FROM ft""")
add("label_components_scene", on("scene", lambda d: R.raster_order(K.label_components(d, C.luma709() < 90).select("image_id", "label").distinct())), src("scene", labels_ctes(_DARK, "lb"), True) + "SELECT image_id, label, dense_rank() OVER (PARTITION BY image_id ORDER BY label) AS n FROM (SELECT DISTINCT image_id, label FROM lb)")
add("component_heights_scene", on("scene", lambda d: D.heights_of(d, C.luma709() < 90)), src("scene", labels_ctes(_DARK, "lb"), True) + "SELECT image_id, label, count(*) AS n, max(y)-min(y)+1 AS height FROM lb GROUP BY image_id, label HAVING count(*)>=4")
add("chamfer_event", on("event", lambda d: R.chamfer_distance(d, F.col("a") == 0, 100)), src("event") + "SELECT s.image_id, s.x, s.y, CAST(coalesce(min((3*(greatest(abs(s.x-t.x),abs(s.y-t.y))-least(abs(s.x-t.x),abs(s.y-t.y)))+4*least(abs(s.x-t.x),abs(s.y-t.y)))), 400)//3 AS INTEGER) AS dist FROM src s LEFT JOIN src t ON t.image_id=s.image_id AND t.a=0 GROUP BY s.image_id, s.x, s.y")
add("wall_distance_event", on("event", lambda d: R.wall_distance(d, 5).select("image_id", "x", "y", F.col("dist").cast("long").alias("dist"))), src("event") + "SELECT s.image_id, s.x, s.y, CAST(CASE WHEN min(abs(s.x-t.x)+abs(s.y-t.y))<=5 THEN min(abs(s.x-t.x)+abs(s.y-t.y)) END AS BIGINT) AS dist FROM src s LEFT JOIN src t ON t.image_id=s.image_id AND t.a<128 GROUP BY s.image_id, s.x, s.y")


def _live_wire(spark: SparkSession, sf: str) -> DataFrame:
    cost = N.edge_map(raster(spark, sf, "event"))
    req = cost.select("image_id").distinct().select("image_id", F.lit(1).alias("seed_x"), F.lit(2).alias("seed_y"), F.lit(13).alias("x"), F.lit(11).alias("y"))
    p = K.live_wire_paths(cost, req)
    # the path's cost: steps cost the mean of their ends times their length
    steps = p.select("image_id", F.posexplode("path").alias("i", "p")).select("image_id", "i", "p.x", "p.y").join(cost, ["image_id", "x", "y"])
    from pyspark.sql import Window as W

    w = W.partitionBy("image_id").orderBy("i")
    length = F.sqrt(F.pow(F.col("x") - F.lag("x").over(w), 2) + F.pow(F.col("y") - F.lag("y").over(w), 2))
    return steps.withColumn("c", (F.col("cost") + F.lag("cost").over(w)) / 2 * length).groupBy("image_id").agg(F.round(F.sum("c"), 6).alias("cost"))


#: Least costs by rounds: a path in a 16 x 16 image has fewer than 256 steps; after 64 rounds none of them changes.
_WIRE = sobel_ctes("src") + """, cost AS MATERIALIZED (SELECT image_id, x, y, CASE WHEN top=0 THEN 1.0 ELSE greatest(0.05, 1-sqrt(g/top)) END AS c FROM gm),
 st AS MATERIALIZED (SELECT a.image_id, a.x AS ax, a.y AS ay, b.x AS tx, b.y AS ty, (a.c+b.c)/2*sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) AS c FROM cost a JOIN cost b ON a.image_id=b.image_id AND greatest(abs(a.x-b.x), abs(a.y-b.y))=1),
 bf AS (SELECT 0 AS it, image_id, x, y, 0.0 AS d FROM cost WHERE x=1 AND y=2
  UNION ALL SELECT it, image_id, x, y, min(d) FROM (SELECT it+1 AS it, image_id, x, y, d FROM bf WHERE it<64 UNION ALL SELECT it+1, st.image_id, tx, ty, bf.d+st.c FROM bf JOIN st ON st.image_id=bf.image_id AND ax=bf.x AND ay=bf.y WHERE it<64) GROUP BY it, image_id, x, y)"""
add("live_wire_event", _live_wire, src("event", _WIRE, True) + "SELECT image_id, round(d, 6) AS cost FROM bf WHERE it=64 AND x=13 AND y=11")

# -- detectors -----------------------------------------------------------------------------------------------------------------


def _spec(spark: SparkSession, sf: str) -> DataFrame:
    return settled(D.detect_checkerboard(raster(spark, sf, "checker")), "spec")


_C3 = "c3 AS (SELECT * FROM (VALUES (6),(10),(16)) t(c))"
add("checker_detect", lambda s, d: D.detect_checkerboard(raster(s, d, "checker")).withColumn("confidence", F.round("confidence", 6)),
    src("checker", """g AS (SELECT image_id, (r+g+b)/3 AS l, greatest(r,g,b)-least(r,g,b) AS sp FROM src WHERE x>=6 AND x<114 AND y>=6 AND y<114 AND (x-6)%2=0 AND (y-6)%2=0),
 p AS (SELECT image_id, count(*) FILTER (sp<=8 AND l=255) AS nl, count(*) FILTER (sp<=8 AND l=217) AS nd, count(*) FILTER (sp<=8) AS n FROM g GROUP BY image_id)""")
    + "SELECT image_id, CAST(255 AS INTEGER) AS light_r, CAST(255 AS INTEGER) AS light_g, CAST(255 AS INTEGER) AS light_b, CAST(217 AS INTEGER) AS dark_r, CAST(217 AS INTEGER) AS dark_g, CAST(217 AS INTEGER) AS dark_b, CAST(image_id AS INTEGER) AS cell_size, round((nl+nd)/n,6) AS confidence FROM p")
add("design_box_checker", lambda s, d: D.design_box(raster(s, d, "checker"), _spec(s, d)), f"WITH {_C3} SELECT c AS image_id, CAST(0 AS INTEGER) AS x, CAST(10 AS INTEGER) AS y, CAST(120 AS INTEGER) AS width, CAST(100 AS INTEGER) AS height FROM c3")
_CLS = "CASE WHEN r=255 AND g=255 AND b=255 THEN 1 WHEN r=217 AND g=217 AND b=217 THEN 2 ELSE 0 END"


def checker_ctes(table: str, w: int, h: int) -> str:
    return f"""cl AS MATERIALIZED (SELECT *, {_CLS} AS c FROM {table}),
 nb AS (SELECT s.image_id, s.x, s.y, count(*) AS n, count(*) FILTER (t.c=3-s.c) AS op FROM cl s {_STEP} JOIN cl t ON t.image_id=s.image_id AND t.x=s.x+o.dx*s.image_id AND t.y=s.y+o.dy*s.image_id WHERE s.c<>0 AND t.c<>0 GROUP BY ALL),
 ic AS MATERIALIZED (SELECT cl.*, coalesce(n>=2 AND op>=ceil(n*0.66), false) AS k FROM cl LEFT JOIN nb USING (image_id, x, y)),
 ar AS (SELECT s.image_id, s.x, s.y, count(*) FILTER (t.k) AS n FROM ic s JOIN ic t ON t.image_id=s.image_id AND t.x BETWEEN s.x-1 AND s.x+1 AND t.y BETWEEN s.y-1 AND s.y+1 GROUP BY ALL),
 res AS (SELECT image_id, x, y, r, g, b, CASE WHEN k OR (c<>0 AND n>=3 AND x BETWEEN 1 AND {w - 2} AND y BETWEEN 1 AND {h - 2}) THEN 0 ELSE a END AS a FROM ic JOIN ar USING (image_id, x, y))"""


add("remove_checker", lambda s, d: digest(D.remove_checkerboard(raster(s, d, "checker"), _spec(s, d))), src("checker", checker_ctes("src", 120, 120)) + digest_sql("res"))
add("extract_from_screenshot_checker", lambda s, d: digest(PL.extract_from_screenshot(raster(s, d, "checker"), lambda x: settled(x, "spec"))), src("checker", "cr AS (SELECT image_id, x, y-10 AS y, r, g, b, a FROM src WHERE y BETWEEN 10 AND 109), " + checker_ctes("cr", 120, 100)) + digest_sql("res"))
add("detect_source_type_scene", on("scene", D.detect_source_type), src("scene") + "SELECT DISTINCT image_id, 'graphic' AS source_type FROM src")
add("detect_source_type_checker", on("checker", D.detect_source_type), f"WITH {_C3} SELECT c AS image_id, 'screenshot' AS source_type FROM c3")
add("checker_overlay", lambda s, d: digest(D.checker_overlay(raster(s, d, "checker"), _spec(s, d), D.design_box(raster(s, d, "checker"), _spec(s, d)))),
    src("checker", checker_ctes("src", 120, 120) + """, fr AS (SELECT s.*, res.a=0 AS hit, (s.x IN (0,119) AND s.y BETWEEN 10 AND 109) OR s.y IN (10,109) AS frame FROM src s JOIN res USING (image_id, x, y)),
 ov AS (SELECT image_id, x, y, CASE WHEN frame THEN 0 WHEN hit THEN 255 ELSE r END AS r, CASE WHEN frame THEN 200 WHEN hit THEN CAST(g AS INTEGER)//2 ELSE g END AS g, CASE WHEN frame THEN 0 WHEN hit THEN 255 ELSE b END AS b, a FROM fr)""") + digest_sql("ov"))  # fmt: skip
_CAND = f"""sn AS (SELECT image_id, CAST(r AS INTEGER)//8*1024+CAST(g AS INTEGER)//8*32+CAST(b AS INTEGER)//8 AS bin FROM src WHERE a>=128 AND NOT ((greatest(r,g,b)>230 AND greatest(r,g,b)-least(r,g,b)<20 AND {_SAT}<0.08) OR (greatest(r,g,b)>180 AND greatest(r,g,b)<230 AND greatest(r,g,b)-least(r,g,b)<12 AND {_SAT}<0.06))),
 op AS (SELECT image_id, count(*) AS opaque FROM sn GROUP BY image_id), bn AS (SELECT image_id, bin, count(*) AS n, any_value(opaque) AS opaque FROM sn JOIN op USING (image_id) GROUP BY image_id, bin HAVING count(*)>=greatest(80, floor(any_value(opaque)*0.003))),
 rk AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, bin) AS k, count(*) OVER (PARTITION BY image_id) AS m FROM bn),
 fin AS (SELECT image_id, bin, n, opaque, k FROM rk WHERE NOT (k=1 AND m>1 AND n>opaque*0.4))"""
add("text_colour_candidates_scene", on("scene", D.colour_candidates), src("scene", _CAND) + "SELECT image_id, CAST(bin//1024 AS INTEGER) AS rb, CAST(bin//32%32 AS INTEGER) AS gb, CAST(bin%32 AS INTEGER) AS bb, n, CAST(row_number() OVER (PARTITION BY image_id ORDER BY k) AS INTEGER) AS rank, opaque FROM fin")
add("detect_text_colours_scene", on("scene", D.detect_text_colours))
add("suppress_close_scene", on("scene", lambda d: D.suppress_close(D.colour_candidates(d), 18).select("image_id", "rank", "rb", "gb", "bb")),
    src("scene", _CAND + """, cd AS MATERIALIZED (SELECT image_id, CAST(bin//1024 AS INTEGER) AS rb, CAST(bin//32%32 AS INTEGER) AS gb, CAST(bin%32 AS INTEGER) AS bb, CAST(row_number() OVER (PARTITION BY image_id ORDER BY k) AS INTEGER) AS rank FROM fin),
 gr AS (SELECT image_id, 0 AS k, CAST([] AS STRUCT(rank INTEGER, rb INTEGER, gb INTEGER, bb INTEGER)[]) AS picked FROM (SELECT DISTINCT image_id FROM cd)
  UNION ALL SELECT gr.image_id, cd.rank, CASE WHEN len(picked)<18 AND len(list_filter(picked, lambda p: 64*((p.rb-cd.rb)*(p.rb-cd.rb)+(p.gb-cd.gb)*(p.gb-cd.gb)+(p.bb-cd.bb)*(p.bb-cd.bb))<28*28))=0
   THEN list_append(picked, {'rank': cd.rank, 'rb': cd.rb, 'gb': cd.gb, 'bb': cd.bb}) ELSE picked END FROM gr JOIN cd ON cd.image_id=gr.image_id AND cd.rank=gr.k+1 WHERE cd.rank<=60),
 ls AS (SELECT image_id, arg_max(picked, k) AS picked FROM gr GROUP BY image_id)""", True) + "SELECT image_id, p.rank AS rank, p.rb AS rb, p.gb AS gb, p.bb AS bb FROM (SELECT image_id, unnest(picked) AS p FROM ls)")  # fmt: skip


def _ink(spark: SparkSession, sf: str) -> DataFrame:
    """A sheet of 128 x 48 for each supplier: two rows of bars in two inks that depend on its key, on coloured ground."""
    key = F.col("s_suppkey")
    d = spark.read.parquet(f"{sf}/supplier.parquet").select(key.cast("int").alias("image_id"), "s_suppkey").repartition(4 * spark.sparkContext.defaultParallelism, "image_id").withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(127)))).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(47))))
    bar = lambda n: (F.col("x") >= 4) & (F.col("x") < 4 + 12 * n) & ((F.col("x") - 4) % 12 < 4)
    one, two = bar(10) & F.col("y").between(10, 17), bar(9) & F.col("y").between(30, 37)
    return d.select("image_id", "x", "y", *[F.when(one, i).when(two, j).otherwise(k).cast("int").alias(c) for c, i, j, k in zip("rgb", *[[F.lit(v) if isinstance(v, int) else v for v in t] for t in _inks(key)], strict=True)], F.lit(255).alias("a"))


def _inks(key) -> list[tuple]:
    """First ink, second ink and ground."""
    return [(200 + key % 50, 30, 20), (20, 150 + key % 60, 60), (40, 90, 200)]


_INKED = """WITH k AS (SELECT CAST(s_suppkey AS INTEGER) AS image_id, s_suppkey AS s FROM supplier), i AS (
 SELECT image_id, 10 AS n, CAST(200+s%50 AS INTEGER) AS r, 30 AS g, 20 AS b FROM k UNION ALL SELECT image_id, 9, 20, CAST(150+s%60 AS INTEGER), 60 FROM k),
 sc AS (SELECT *, n*(1+(greatest(r,g,b)-least(r,g,b))/greatest(r,g,b)*1.5+greatest(0.0, 1-(r+g+b)/765-0.3)*1.2) AS score FROM i)
SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY score DESC) AS INTEGER) AS rank, printf('#%02x%02x%02x', r, g, b) AS hex, CAST(n*32 AS BIGINT) AS pixels, CAST(n AS BIGINT) AS components, CAST(8 AS INTEGER) AS median_height, 32.0 AS mean_pixels FROM sc"""
add("detect_text_colours_ink", lambda s, d: D.detect_text_colours(settled(_ink(s, d), "ink")), _INKED)
add("colour_mask_scene", on("scene", lambda d: D.colour_mask(d, "#8040c0").groupBy("image_id").agg(F.sum("m").cast("long").alias("m"))), src("scene") + "SELECT image_id, count(*) FILTER (a>=128 AND (r-128)*(r-128)+(g-64)*(g-64)+(b-192)*(b-192)<=18*18) AS m FROM src GROUP BY image_id")


def _overlays(spark: SparkSession, sf: str) -> DataFrame:
    """Two flat layers over an event tile enlarged twofold; their masks are the tile's bright and red places."""
    d = raster(spark, sf, "event")
    base = d.select("image_id", F.explode(F.sequence(F.col("x") * 2, F.col("x") * 2 + 1)).alias("x"), "y", "r", "g", "b", "a").select("image_id", "x", F.explode(F.sequence(F.col("y") * 2, F.col("y") * 2 + 1)).alias("y"), "r", "g", "b", "a")
    layer = lambda k, rgb, a: base.select("image_id", F.lit(k).alias("layer"), "x", "y", *[F.lit(v).alias(c) for c, v in zip("rgb", rgb, strict=True)], F.lit(a).alias("a"))
    pixels = layer(0, (250, 10, 20), 128).unionByName(layer(1, (0, 200, 40), 200))
    masks = d.select("image_id", F.lit(0).alias("layer"), "x", "y", (F.col("g") >= 120).cast("int").alias("m")).unionByName(d.select("image_id", F.lit(1).alias("layer"), "x", "y", (F.col("r") >= 200).cast("int").alias("m")))
    return digest(D.compose_overlays(base, (pixels, masks), (16, 16), (32, 32), 1, 2))


_BLEND = lambda t, rgb, k: ", ".join(f"CASE WHEN {t} THEN {st(f'{v}*({k}/255)+{c}*(1-{k}/255)')} ELSE {c} END AS {c}" for c, v in zip("rgb", rgb, strict=True)) + f", CASE WHEN {t} THEN greatest(a,{k}) ELSE a END AS a"
add("compose_overlays_event", _overlays, src("event", "bs AS (SELECT image_id, x*2+i AS x, y*2+j AS y, r, g, b, a FROM src, range(2) p(i), range(2) q(j)), al AS (SELECT image_id, x, y, CAST(a>=16 AS INTEGER) AS m FROM bs), " + sep_sql("al", "m", 2, "max", "nr")
    + ", m0 AS (SELECT image_id, x, y, CAST(g>=120 AS INTEGER) AS m FROM src), m1 AS (SELECT image_id, x, y, CAST(r>=200 AS INTEGER) AS m FROM src), " + sep_sql("m0", "m", 1, "max", "g0") + ", " + sep_sql("m1", "m", 1, "max", "g1")
    + ", j AS (SELECT bs.*, nr.v AS near, g0.v AS k0, g1.v AS k1 FROM bs JOIN nr USING (image_id, x, y) JOIN g0 ON g0.image_id=bs.image_id AND g0.x=bs.x//2 AND g0.y=bs.y//2 JOIN g1 ON g1.image_id=bs.image_id AND g1.x=bs.x//2 AND g1.y=bs.y//2)"
    + f", l0 AS (SELECT image_id, x, y, near, k1, {_BLEND('near=1 AND k0=1', (250, 10, 20), 128)} FROM j), res AS (SELECT image_id, x, y, {_BLEND('near=1 AND k1=1', (0, 200, 40), 200)} FROM l0)") + digest_sql("res"))

# -- text removal ----------------------------------------------------------------------------------------------------------------


def _letters(spark: SparkSession, sf: str) -> DataFrame:
    """A sheet of 200 x 200 for each region: three rows of small bars on transparent ground, a disc, dots beside a row."""
    ids = spark.read.parquet(f"{sf}/region.parquet").select(F.col("r_regionkey").cast("int").alias("image_id"))
    d = ids.select("image_id", F.explode(F.sequence(F.lit(0), F.lit(199))).alias("x")).select("image_id", "x", F.explode(F.sequence(F.lit(0), F.lit(199))).alias("y"))
    row = F.col("y").between(60, 68) | F.col("y").between(90, 98) | F.col("y").between(120, 128)
    bar = row & F.col("x").between(40, 150) & ((F.col("x") - 40) % 12 < 7)
    disc = (F.col("x") - 100) * (F.col("x") - 100) + (F.col("y") - 165) * (F.col("y") - 165) <= 144
    dot = F.col("y").between(131, 132) & F.col("x").between(60, 61)
    on_ = bar | disc | dot
    return d.select("image_id", "x", "y", F.when(disc, F.col("x")).otherwise(20 + F.col("image_id") * 5).alias("r"), F.when(disc, 255 - F.col("y")).otherwise(30).alias("g"), F.when(disc, 128).otherwise(40).alias("b"), F.when(on_, 255).otherwise(0).alias("a"))


#: What is text on a sheet, box by box: ten bars in each row, the last one cut at 150, and the dot. The disc is not.
_LETTERS = """WITH ids AS (SELECT CAST(r_regionkey AS INTEGER) AS image_id FROM region), boxes AS (
 SELECT 40+12*i AS x0, y AS y0, least(46+12*i, 150) AS x1, y+8 AS y1 FROM range(10) p(i) CROSS JOIN (VALUES (60),(90),(120)) q(y) UNION ALL SELECT 60, 131, 61, 132) """
add("text_scoring_letters", lambda s, d: (lambda x: (lambda lf: lf[1].where(T.text_score(lf[1])).select("image_id", "label", "count", "min_x", "min_y", "max_x", "max_y"))(T._labelled(x, T._mask(x, F.col("a") >= 32))))(_letters(s, d)), _LETTERS + "SELECT image_id, CAST(y0*200+x0 AS BIGINT) AS label, CAST((x1-x0+1)*(y1-y0+1) AS BIGINT) AS count, CAST(x0 AS INTEGER) AS min_x, CAST(y0 AS INTEGER) AS min_y, CAST(x1 AS INTEGER) AS max_x, CAST(y1 AS INTEGER) AS max_y FROM ids CROSS JOIN boxes")
add("row_clusters_letters", lambda s, d: (lambda x: T.row_clusters(T._labelled(x, T._mask(x, F.col("a") >= 32))[1]).groupBy("image_id", "row").agg(F.count("*").alias("n")))(_letters(s, d)), _LETTERS + "SELECT image_id, CAST(row AS INTEGER) AS row, CAST(n AS BIGINT) AS n FROM ids CROSS JOIN (VALUES (1,10),(2,10),(3,10),(4,1),(5,1)) t(row,n)")
add("remove_text_letters", lambda s, d: (lambda x: T.remove_text(x, lambda y: settled(y, "pass")).groupBy("image_id").agg(F.count_if(F.col("a") > 0).alias("still_visible"), F.max(F.when(F.col("a") > 0, F.col("y"))).alias("lowest")))(settled(_letters(s, d), "letters")), _LETTERS + "SELECT image_id, count(*) AS still_visible, CAST(max(y) AS INTEGER) AS lowest FROM ids CROSS JOIN range(200) p(x) CROSS JOIN range(200) q(y) WHERE (x-100)*(x-100)+(y-165)*(y-165)<=144 GROUP BY image_id")

# -- kernels -----------------------------------------------------------------------------------------------------------------


def unpremultiplied(alpha: str) -> str:
    """r, g, b, a of premultiplied channels, as bytes."""
    return ", ".join(f"CASE WHEN {alpha}>0 THEN {st(f'{c}*(255/{alpha})')} ELSE 0 END AS {c}" for c in "rgb") + f", {st(alpha)} AS a"


def _places(w: int, h: int) -> str:
    return f"(SELECT DISTINCT image_id FROM src) i CROSS JOIN range({w}) p(x) CROSS JOIN range({h}) q(y)"


# places of the turned box, mapped back into the tile; outside it is clear
_TURN = f"""pm AS (SELECT image_id, x, y, {', '.join(f'{c}*(a/255) AS {c}' for c in 'rgb')}, CAST(a AS DOUBLE) AS a FROM src),
 bx AS (SELECT i.image_id, p.x, q.y, (p.x+0.5-11)*cos(radians(30.0))+(q.y+0.5-11)*sin(radians(30.0))+7.5 AS sx, -(p.x+0.5-11)*sin(radians(30.0))+(q.y+0.5-11)*cos(radians(30.0))+7.5 AS sy FROM {_places(22, 22)}),
 cn AS (SELECT image_id, x, y, CAST(floor(sx) AS INTEGER)+dx AS kx, CAST(floor(sy) AS INTEGER)+dy AS ky, CASE WHEN dx=1 THEN sx-floor(sx) ELSE 1-(sx-floor(sx)) END*CASE WHEN dy=1 THEN sy-floor(sy) ELSE 1-(sy-floor(sy)) END AS w FROM bx CROSS JOIN range(2) u(dx) CROSS JOIN range(2) v(dy)),
 sm AS (SELECT cn.image_id, cn.x, cn.y, {', '.join(f'coalesce(sum(pm.{c}*w),0) AS {c}' for c in 'rgba')} FROM cn LEFT JOIN pm ON pm.image_id=cn.image_id AND pm.x=cn.kx AND pm.y=cn.ky GROUP BY ALL),
 tn AS (SELECT image_id, x, y, {unpremultiplied('a')} FROM sm)"""
_BELL = "exp(-(i*i)/2.0)/(SELECT sum(exp(-(k*k)/2.0)) FROM (SELECT k-3 AS k FROM range(7) t(k)))"
_SHADOW = f"""tp AS (SELECT i, {_BELL} AS w FROM (SELECT i-3 AS i FROM range(7) t(i))),
 sd AS (SELECT s.image_id, s.x+10+u.i AS x, s.y+12+v.i AS y, sum(a*u.w*v.w)*0.5 AS sh FROM src s CROSS JOIN tp u CROSS JOIN tp v GROUP BY ALL),
 cv AS (SELECT i.image_id, p.x, q.y, {', '.join(f'coalesce(s.{c}*(s.a/255),0) AS {c}' for c in 'rgb')}, coalesce(s.a,0)+coalesce(sh,0)*(1-coalesce(s.a,0)/255) AS a FROM {_places(30, 32)} LEFT JOIN src s ON s.image_id=i.image_id AND s.x=p.x-7 AND s.y=q.y-8 LEFT JOIN sd ON sd.image_id=i.image_id AND sd.x=p.x AND sd.y=q.y),
 dsh AS (SELECT image_id, x, y, {unpremultiplied('a')} FROM cv)"""


def resize_sql(side: int, x0: int, y0: int, w: int, h: int) -> str:
    """A tile halved once to 8 x 8, brought to ``side`` and laid at (x0, y0) of a canvas of w x h."""
    half = f"hp AS (SELECT image_id, CAST(x AS INTEGER)//2 AS x, CAST(y AS INTEGER)//2 AS y, {', '.join(f'avg({c}*(a/255)) AS {c}' for c in 'rgb')}, avg(a) AS a FROM src GROUP BY ALL), hf AS (SELECT image_id, x, y, {unpremultiplied('a')} FROM hp)"
    laid = f"ld AS (SELECT i.image_id, p.x, q.y, {', '.join(f'coalesce(rs.{c},0) AS {c}' for c in 'rgba')} FROM {_places(w, h)} LEFT JOIN rs ON rs.image_id=i.image_id AND rs.x=p.x-({x0}) AND rs.y=q.y-({y0}))"
    return src("event", f"{half}, {resample_ctes('hf', 8, side, 'bilinear')}, {laid}") + digest_sql("ld")



add("rotate_degrees_event", on("event", lambda d: digest(K.rotate_degrees(d, 30))), src("event", _TURN) + digest_sql("tn"))
add("drop_shadow_event", on("event", lambda d: digest(K.drop_shadow(d, 3, 4, 2, "#000000", 0.5))), src("event", _SHADOW) + digest_sql("dsh"))
add("resize_contain_event", on("event", lambda d: digest(K.resize_images(d, 10, 6, "contain"))), resize_sql(6, 2, 0, 10, 6))
add("resize_cover_event", on("event", lambda d: digest(K.resize_images(d, 7, 5, "cover"))), resize_sql(7, 0, -1, 7, 5))
add("resample_kernel_embed", on("embed", lambda d: K.resample_images(d, 96, 96).select(*PIX.split(", "))), resample_sql("embed", 64, 96, "lanczos3"))
add("acrylic_preview_event", on("event", lambda d: digest(K.acrylic_preview(d, 240, 12))))
add("png_round_trip_event", on("event", lambda d: digest(I.to_pixels(_through_png(d)))), src("event") + digest_sql("src"))
add("png_dpi_event", on("event", lambda d: _dpi(d)), src("event") + "SELECT DISTINCT image_id, CAST(11811 AS BIGINT) AS ppm FROM src")


def _through_png(d: DataFrame) -> DataFrame:
    files = I.encode(I.from_pixels(d), dpi=300)
    return I.decode(files.select(F.concat(F.lit("/x/"), "name").alias("path"), "content")).withColumn("image_id", F.col("name").cast("long"))


def _dpi(d: DataFrame) -> DataFrame:
    """The pHYs chunk, read back with built-ins: it stands right after the header."""
    files = I.encode(I.from_pixels(d), dpi=300)
    return files.select("image_id", F.conv(F.hex(F.substring("content", 42, 4)), 16, 10).cast("long").alias("ppm"))


# -- packed tiles ----------------------------------------------------------------------------------------------------------------
# on tiles of 7 places the small images of event meet every seam; mosaic is one image, larger with the table


def by_tiles(fixture: str, op: Callable[[DataFrame], DataFrame], tile: int = 7) -> Query:
    return lambda spark, sf: op(tiles(spark, sf, fixture, tile))


def same_sql(name: str, op: Callable[[DataFrame], DataFrame], as_query: str) -> None:
    """The tiled form of a registered query, beside that query's SQL."""
    add(name, by_tiles("event", op))
    _SQL[name] = _SQL[as_query]


same_sql("erode_tiles_event", lambda t: TP.unpack(TP.erode_alpha(t, 2)), "erode_alpha_event")
same_sql("dilate_tiles_event", lambda t: TP.unpack(TP.dilate_alpha(t, 2)), "dilate_alpha_event")
same_sql("feather_tiles_event", lambda t: TP.unpack(TP.feather_alpha(t, 2)).select("image_id", "x", "y", "a"), "feather_alpha_event")
same_sql("edge_map_tiles_event", lambda t: TP.unpack(TP.edge_map(t), ("cost",), "f8", "double").withColumn("cost", F.round("cost", 6)), "edge_map_event")
same_sql("edge_aware_sharpen_tiles_event", lambda t: TP.unpack(TP.edge_aware_sharpen(t)), "edge_aware_sharpen_event")
same_sql("chamfer_tiles_event", lambda t: TP.unpack(TP.chamfer(t, lambda px: px[..., 3] == 0, 100), ("dist",), "<i4"), "chamfer_event")
same_sql("rotate_tiles_event", lambda t: digest(TP.unpack(TP.rotate_degrees(t, 30))), "rotate_degrees_event")
same_sql("resize_contain_tiles_event", lambda t: digest(TP.unpack(TP.resize(t, 10, 6, "contain"))), "resize_contain_event")
same_sql("resize_cover_tiles_event", lambda t: digest(TP.unpack(TP.resize(t, 7, 5, "cover"))), "resize_cover_event")
same_sql("drop_shadow_tiles_event", lambda t: digest(TP.unpack(TP.drop_shadow(t, 3, 4, 2, "#000000", 0.5))), "drop_shadow_event")


def banded(df: DataFrame) -> DataFrame:
    """One checksum for 64 rows of places."""
    return df.groupBy(F.floor(F.col("y") / 64).alias("band")).agg(F.count("*").alias("n"), F.sum(F.expr(LONG_KEY).cast("long")).alias("checksum"))


def banded_tiles(t: DataFrame) -> DataFrame:
    """``banded`` of the pixels of tiles, summed tile by tile."""
    sums = TP.row_sums(t, lambda px, x, y: (x * 31 + y * 17 + 1) * (px.astype(np.int64) @ np.array([3, 5, 7, 11])), 64)
    return sums.select("band", "n", F.col("total").alias("checksum"))


def banded_sql(table: str) -> str:
    return f"SELECT CAST(floor(y/64.0) AS BIGINT) AS band, count(*) AS n, CAST(sum({KEY}) AS BIGINT) AS checksum FROM {table} GROUP BY ALL"


def mosaic(name: str, ctes: str, table: str, *, pixels: Callable[[DataFrame], DataFrame] | None = None, tiled: Callable[[DataFrame], DataFrame] | None = None) -> None:
    if pixels:
        add(f"{name}_mosaic", lambda s, d: banded(pixels(raster(s, d, "mosaic"))), src("mosaic", ctes) + banded_sql(table))
    if tiled:
        add(f"{name}_tiles_mosaic", lambda s, d: banded_tiles(tiled(tiles(s, d, "mosaic"))), src("mosaic", ctes) + banded_sql(table))


mosaic("erode_wide", sep_sql("src", "a", 40, "min", "m", ", r, g, b") + ", o AS (SELECT image_id, x, y, r, g, b, v AS a FROM m)", "o", pixels=lambda d: N.erode_alpha(d, 40), tiled=lambda t: TP.erode_alpha(t, 40))


def box_mean_ctes(r: int) -> str:
    """Alpha's box mean with the border repeated, as running window sums and border values."""
    def one(at: str, other: str, v: str, table: str, out: str) -> str:
        w = f"PARTITION BY image_id, {other} ORDER BY {at}"
        whole = f"({w} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
        return f"{out} AS (SELECT image_id, x, y, r, g, b, sum({v}) OVER ({w} ROWS BETWEEN {r} PRECEDING AND {r} FOLLOWING)+greatest(0,{r}-{at})*first({v}) OVER {whole}+greatest(0,{at}+{r}-max({at}) OVER {whole})*last({v}) OVER {whole} AS s FROM {table})"

    return one("x", "y", "a", "src", "fx") + ", " + one("y", "x", "s", "fx", "fy") + f", o AS (SELECT image_id, x, y, r, g, b, CAST(floor(s/{(2 * r + 1) ** 2}+0.5) AS INTEGER) AS a FROM fy)"


mosaic("feather_wide", box_mean_ctes(20), "o", pixels=lambda d: N.feather_alpha(d, 20), tiled=lambda t: TP.feather_alpha(t, 20))
mosaic("sharpen", sharpen_ctes("src", "o", 0.25), "o", tiled=lambda t: TP.sharpen(t, 0.25))
#: The gradient by windows: joins on one image's id would pair all its places.
_SOBEL_WINDOWS = f"""lum AS (SELECT x, y, {_LUMA6} AS l FROM src), rd AS (SELECT x, y, lead(l) OVER w-lag(l) OVER w AS d, lag(l) OVER w+2*l+lead(l) OVER w AS s FROM lum WINDOW w AS (PARTITION BY y ORDER BY x)),
 gr AS (SELECT x, y, coalesce(sqrt(pow(lag(d) OVER w+2*d+lead(d) OVER w,2)+pow(lead(s) OVER w-lag(s) OVER w,2)),0) AS g FROM rd WINDOW w AS (PARTITION BY x ORDER BY y)), gm AS (SELECT *, max(g) OVER () AS top FROM gr)"""
def _edge_bands(spark: SparkSession, sf: str) -> DataFrame:
    def cost(px: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.floor(px[..., 0] * 10000 + 0.5) * (x % 7 + 1)

    sums = TP.row_sums(TP.edge_map(tiles(spark, sf, "mosaic")), cost, 64, dtype="f8", channels=1)
    return sums.select("band", "n", F.col("total").alias("checksum"))


add("edge_map_tiles_mosaic", _edge_bands,
    src("mosaic", _SOBEL_WINDOWS) + "SELECT CAST(floor(y/64.0) AS BIGINT) AS band, count(*) AS n, CAST(sum(round(CASE WHEN top=0 THEN 1.0 ELSE greatest(0.05, 1-sqrt(g/top)) END*10000)*(x%7+1)) AS BIGINT) AS checksum FROM gm GROUP BY ALL")
_SIZE = "sz AS (SELECT CAST(max(x)+1 AS DOUBLE) AS w, CAST(max(y)+1 AS DOUBLE) AS h FROM src)"


def mosaic_taps(side: str, target: int, name: str, out: str) -> str:
    """Resampling weights of one axis whose length is a column of sz."""
    return f"""{out}0 AS (SELECT j, k, CAST({filter_sql('((k-c)/spread)', name)} AS DOUBLE) AS w FROM (SELECT *, unnest(range(CAST(greatest(0, floor(c-{C.FILTER_RADIUS[name]}*spread)) AS BIGINT), CAST(least(n-1, ceil(c+{C.FILTER_RADIUS[name]}*spread)) AS BIGINT)+1)) AS k
  FROM (SELECT CAST(j AS INTEGER) AS j, (j+0.5)*({side}/{target})-0.5 AS c, greatest(1.0, {side}/{target}) AS spread, {side} AS n FROM sz CROSS JOIN range({target}) t(j)))), {out} AS (SELECT j, k, w/sum(w) OVER (PARTITION BY j) AS w FROM {out}0)"""


_RS = f"""{_SIZE}, {mosaic_taps('w', 700, 'lanczos3', 'wx')}, {mosaic_taps('h', 300, 'lanczos3', 'wy')},
 h1 AS (SELECT image_id, j AS x, y, {', '.join(f'sum({c}*(a/255)*w) AS {c}' for c in 'rgb')}, sum(a*w) AS a FROM src JOIN wx ON k=x GROUP BY image_id, j, y),
 v1 AS (SELECT image_id, x, j AS y, {', '.join(f'sum({c}*w) AS {c}' for c in 'rgba')} FROM h1 JOIN wy ON k=y GROUP BY image_id, x, j),
 o AS (SELECT image_id, x, y, {', '.join('CASE WHEN a<=0 THEN 0 ELSE ' + st(f'round({c}*(255/a),6)') + f' END AS {c}' for c in 'rgb')}, CASE WHEN a<=0 THEN 0 ELSE {st('round(a,6)')} END AS a FROM v1)"""
mosaic("resample", _RS, "o", tiled=lambda t: TP.resample(t, 700, 300))
_SPIN = f"""{_SIZE}, pm AS (SELECT x, y, {', '.join(f'{c}*(a/255) AS {c}' for c in 'rgb')}, CAST(a AS DOUBLE) AS a FROM src),
 bb AS (SELECT w, h, ceil(w*cos(radians(30.0))+h*sin(radians(30.0))-0.000000001) AS nw, ceil(w*sin(radians(30.0))+h*cos(radians(30.0))-0.000000001) AS nh FROM sz),
 pl AS (SELECT *, unnest(range(CAST(nh AS BIGINT))) AS y FROM (SELECT *, unnest(range(CAST(nw AS BIGINT))) AS x FROM bb)),
 bx AS (SELECT x, y, (x+0.5-nw/2)*cos(radians(30.0))+(y+0.5-nh/2)*sin(radians(30.0))+w/2-0.5 AS sx, -(x+0.5-nw/2)*sin(radians(30.0))+(y+0.5-nh/2)*cos(radians(30.0))+h/2-0.5 AS sy FROM pl),
 cn AS (SELECT x, y, CAST(floor(sx) AS BIGINT)+dx AS kx, CAST(floor(sy) AS BIGINT)+dy AS ky, CASE WHEN dx=1 THEN sx-floor(sx) ELSE 1-(sx-floor(sx)) END*CASE WHEN dy=1 THEN sy-floor(sy) ELSE 1-(sy-floor(sy)) END AS wt FROM bx CROSS JOIN range(2) u(dx) CROSS JOIN range(2) v(dy)),
 sm AS (SELECT cn.x, cn.y, {', '.join(f'coalesce(sum(pm.{c}*wt),0) AS {c}' for c in 'rgba')} FROM cn LEFT JOIN pm ON pm.x=cn.kx AND pm.y=cn.ky GROUP BY ALL),
 o AS (SELECT x, y, {', '.join('CASE WHEN a>0 THEN ' + st(f'{c}*(255/a)') + f' ELSE 0 END AS {c}' for c in 'rgb')}, {st('a')} AS a FROM sm)"""
mosaic("rotate", _SPIN, "o", tiled=lambda t: TP.rotate_degrees(t, 30, sparse=True))


# -- values that spread over tiles --------------------------------------------------------------------------------------------------

add("depth_flood_tiles_scene", lambda s, d: TP.unpack(RX.depth_flood(tiles(s, d, "scene", 32), "#ffffff", 12, 40, 3), ("depth",), "<i4").where("depth >= 0").groupBy("image_id", "depth").agg(F.count("*").alias("n")), _SQL["depth_flood_scene"])


def _wire_path(spark: SparkSession, sf: str) -> DataFrame:
    cost = N.edge_map(raster(spark, sf, "event"))
    req = cost.select("image_id").distinct().select("image_id", F.lit(1).alias("seed_x"), F.lit(2).alias("seed_y"), F.lit(13).alias("x"), F.lit(11).alias("y"))
    p = K.live_wire_paths(cost, req).select("image_id", F.posexplode(F.reverse("path")).alias("step", "p"))
    return p.select("image_id", "step", "p.x", "p.y")


def _wire_tiles(spark: SparkSession, sf: str) -> DataFrame:
    cost = settled(TP.edge_map(tiles(spark, sf, "event", 8)), "wire-cost")
    req = cost.select("image_id").distinct().select("image_id", F.lit(1).alias("sx"), F.lit(2).alias("sy"), F.lit(13).alias("x"), F.lit(11).alias("y"))
    return RX.cheapest_paths(cost, req).select("image_id", "step", "x", "y")


#: Back from the target to the neighbour that gives its cost: of several the cheaper one, then the first row by row.
_WIRE_PATH = src("event", _WIRE + """, ds AS MATERIALIZED (SELECT image_id, x, y, d FROM bf WHERE it=64),
 pr AS MATERIALIZED (SELECT st.image_id, tx AS x, ty AS y, (list({'px': ax, 'py': ay} ORDER BY p.d, ay, ax))[1] AS w FROM st JOIN ds p ON p.image_id=st.image_id AND p.x=ax AND p.y=ay JOIN ds q ON q.image_id=st.image_id AND q.x=tx AND q.y=ty WHERE p.d+st.c=q.d GROUP BY ALL),
 pt AS (SELECT DISTINCT image_id, 0 AS step, 13 AS x, 11 AS y FROM ds UNION ALL SELECT pt.image_id, step+1, w.px, w.py FROM pt JOIN pr ON pr.image_id=pt.image_id AND pr.x=pt.x AND pr.y=pt.y WHERE NOT (pt.x=1 AND pt.y=2))""", True) + "SELECT image_id, CAST(step AS INTEGER) AS step, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y FROM pt"
add("live_wire_path_event", _wire_path, _WIRE_PATH)
add("live_wire_tiles_event", _wire_tiles, _WIRE_PATH)

# -- outlines --------------------------------------------------------------------------------------------------------------------------


def _trace(spark: SparkSession, sf: str) -> DataFrame:
    """Each dark component: its area and perimeter by its rings, outer ones and holes."""
    d = raster(spark, sf, "scene")
    rings = TR.rings(d.where(C.luma709() < 90))
    start = rings.select("image_id", F.shiftright(F.shiftleft(F.col("ring"), 31), 33).cast("int").alias("x"), F.shiftright("ring", 33).cast("int").alias("y"), "area", "length")
    return start.join(K.label_components(d, C.luma709() < 90), ["image_id", "x", "y"]).groupBy("image_id", "label").agg(F.sum("area").alias("area"), F.sum("length").alias("perimeter"), F.count_if(F.col("area") > 0).alias("around"), F.count_if(F.col("area") < 0).alias("holes"))


#: Sides that are not shared make the perimeter; outward less inward corners are four for each ring around, less four for each hole.
_OUTLINE = labels_ctes(_DARK, "lb") + """, nb AS (SELECT a.image_id, a.x, a.y, any_value(a.label) AS label, """ + ", ".join(f"count(*) FILTER (b.x=a.x+({dx}) AND b.y=a.y+({dy})) AS n{i}" for i, (dx, dy) in enumerate([(0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1)])) + """
  FROM lb a LEFT JOIN lb b ON b.image_id=a.image_id AND b.x BETWEEN a.x-1 AND a.x+1 AND b.y BETWEEN a.y-1 AND a.y+1 GROUP BY a.image_id, a.x, a.y),
 tot AS (SELECT image_id, label, count(*) AS area, sum(4-n0-n2-n4-n6) AS perimeter, sum(""" + "+".join(f"CAST(n{a}+n{b}=0 AS INTEGER)-CAST(n{a}+n{b}=2 AND n{c}=0 AS INTEGER)" for a, c, b in ((0, 1, 2), (2, 3, 4), (4, 5, 6), (6, 7, 0))) + ") AS turns FROM nb GROUP BY image_id, label)"
add("trace_rings_scene", _trace, src("scene", _OUTLINE, True) + "SELECT image_id, label, CAST(area AS BIGINT) AS area, CAST(perimeter AS BIGINT) AS perimeter, CAST(1 AS BIGINT) AS around, CAST(1-turns//4 AS BIGINT) AS holes FROM tot")
add("trace_refill_scene", lambda s, d: TR.filled(TR.rings(raster(s, d, "scene").where(C.luma709() < 90))).groupBy("image_id").agg(F.count("*").alias("n"), F.sum(F.col("y").cast("long") * 64 + F.col("x")).alias("places")), src("scene") + f"SELECT image_id, count(*) AS n, CAST(sum(y*64+x) AS BIGINT) AS places FROM src WHERE {_DARK} GROUP BY image_id")

# -- audit of a folder ----------------------------------------------------------------------------------------------------------------


def _audited(spark: SparkSession, sf: str) -> DataFrame:
    """Tiles of event as files beside processed ones: erased where x + y divides by 5, without an original, or cut to another size."""
    d = raster(spark, sf, "event")
    i = F.col("image_id")
    done = d.where((i % 7 != 3) | (F.col("y") < 9)).withColumn("a", F.when((F.col("x") + F.col("y") + i) % 5 == 0, 0).otherwise(F.col("a")))
    first = I.from_pixels(d.where(i % 6 != 1)).withColumn("name", F.concat(F.lit("i"), "image_id"))
    second = I.from_pixels(done).withColumn("name", F.concat(F.lit("i"), "image_id", F.lit(I.PROCESSED)))
    at = folder(spark, "audit")
    SK.save_images(I.encode(first.unionByName(second)), at)
    return AU.audit_report(spark, at)


add("audit_report", _audited, src("event", """e AS (SELECT image_id, a>=32 AND (x+y+image_id)%5=0 AS gone, x<16*0.05 OR x>=16*(1-0.05) OR y<16*0.10 OR y>=16*(1-0.10) AS band FROM src),
 s AS (SELECT image_id, CASE WHEN image_id%6=1 THEN 'no original' WHEN image_id%7=3 THEN 'size differs' ELSE 'ok' END AS status, count(*) AS n, count(*) FILTER (gone) AS t, count(*) FILTER (gone AND band) AS b FROM e GROUP BY image_id)""")
    + f"SELECT 'i' || image_id || '{I.PROCESSED}' AS name, status, CASE WHEN status='ok' THEN t END AS total_erased, CASE WHEN status='ok' THEN b END AS edge_erased, CASE WHEN status='ok' THEN b/n END AS edge_frac, CASE WHEN status='ok' THEN t/n END AS total_frac FROM s")

# -- composites ------------------------------------------------------------------------------------------------------------------

_PH = L.PHOTO_AUTO


def photo_ctes(fixture: str) -> str:
    def stage(prev: str, out: str, **ch: str) -> str:
        return f"{out} AS (SELECT image_id, x, y, {', '.join(f'{ch.get(c, c)} AS {c}' for c in 'rgba')} FROM {prev})"

    return ", ".join([
        levels_ctes("src", "lv"),
        stage("lv", "e1", **{c: st(f"{c}+0.18*90*pow(1-{_LUMA}/255,2)+(-0.1)*90*pow({_LUMA}/255,2)") for c in "rgb"}),
        stage("e1", "e2", r=st("r+0.04*25"), b=st("b-0.04*25")),
        stage("e2", "e3", **{c: st(f"({c}+5*1.275-128)*pow(1.12,2)+128") for c in "rgb"}),
        stage("e3", "e4", **{c: st(f"{_LUMA}+({c}-{_LUMA})*1.08") for c in "rgb"}),
        stage("e4", "e5", **{c: st(f"{_LUMA}+({c}-{_LUMA})*(1+0.18*(1-{_SAT}))") for c in "rgb"}),
        sharpen_ctes("e5", "e6", 0.25),
    ])


add("enhance_photo_scene", on("scene", lambda d: PL.enhance_photo(d, _PH), digested=True), src("scene", photo_ctes("scene")) + digest_sql("e6"))
add("enhance_graphic_event", on("event", lambda d: PL.enhance_graphic(d, L.GRAPHIC_AUTO).select(*PIX.split(", "))), src("event", f"""g1 AS (SELECT image_id, x, y, {', '.join(st(f'({c}-128)*pow(1.15,2)+128') + f' AS {c}' for c in 'rgb')}, a FROM src),
 g2 AS (SELECT image_id, x, y, {', '.join(st(f'{_LUMA}+({c}-{_LUMA})*(1+0.25*(1-{_SAT}))') + f' AS {c}' for c in 'rgb')}, CASE WHEN a<=44.8 THEN 0 WHEN a>=211.2 THEN 255 ELSE CAST(floor((a-(32+0.2*64))/((224-0.2*64)-(32+0.2*64))*255+0.5) AS INTEGER) END AS a FROM g1), """ + sharpen_ctes("g2", "g3", 0.35)) + f"SELECT {PIX} FROM g3")
add("dtf_finish_event", on("event", lambda d: PL.dtf_finish(d, {"despill": True, "solid_edges": True, "alpha_threshold": 128, "choke": 1}, "#00b140").select(*PIX.split(", "))),
    src("event", "ds AS (SELECT image_id, x, y, r, CASE WHEN a>0 AND a<255 AND g>greatest(r,b) THEN greatest(r,b) ELSE g END AS g, b, a FROM src), " + sep_sql("ds", "a", 1, "min", "m", ", r, g, b")) + "SELECT image_id, x, y, r, g, b, CASE WHEN v>=128 THEN 255 ELSE 0 END AS a FROM m")
_TP = {"color": "#ffffff", "tolerance": 12, "strategy": "flood", "edge_feather": 1, "finish": {"solid_edges": True, "alpha_threshold": 128, "choke": 1, "despill": True}}
add("trainer_pipeline_scene", on("scene", lambda d: PL.trainer_pipeline(d, _TP), digested=True), src("scene", flood_ctes(f"a<>0 AND {_WHITE}<=pow(0.12,2)*195075", "f") + ", " + _FLOODED
    + """, o9 AS (SELECT i-1 AS dx, j-1 AS dy FROM range(3) p(i), range(3) q(j)), fe AS (SELECT s.image_id, s.x, s.y, any_value(s.r) AS r, any_value(s.g) AS g, any_value(s.b) AS b, CAST(floor(avg(t.a)+0.5) AS INTEGER) AS a FROM res s CROSS JOIN o9 JOIN res t ON t.image_id=s.image_id AND t.x=least(63,greatest(0,s.x+dx)) AND t.y=least(63,greatest(0,s.y+dy)) GROUP BY s.image_id, s.x, s.y),
 ds AS (SELECT image_id, x, y, r, CASE WHEN a>0 AND a<255 AND g>greatest(r,b) THEN greatest(r,b) ELSE g END AS g, b, a FROM fe), """ + sep_sql("ds", "a", 1, "min", "mm", ", r, g, b") + ", fin AS (SELECT image_id, x, y, r, g, b, CASE WHEN v>=128 THEN 255 ELSE 0 END AS a FROM mm)", True) + digest_sql("fin"))  # fmt: skip
add("remove_all_background_rings", on("rings", lambda d: PL.remove_all_background(d, "#ffffff").groupBy("image_id").agg(F.count_if((F.col("a") == 0) & (F.col("r") == 255)).alias("white_gone"))), src("rings") + "SELECT image_id, count(*) FILTER (r=255 AND a=255 AND image_id<=14) AS white_gone FROM src GROUP BY image_id")
_OWN = "(r-br)*(r-br)+(g-bg)*(g-bg)+(b-bb)*(b-bb)"
_AUTO = _BG + f""", pk AS (SELECT image_id, br, bg, bb, least(6, greatest(3, floor(coalesce(noise,0)+2.5))) AS tight FROM col JOIN bgc USING (image_id)), sk AS MATERIALIZED (SELECT src.*, br, bg, bb, tight FROM src JOIN pk USING (image_id)),
 k AS MATERIALIZED (SELECT image_id, x, y, {_OWN}<=pow(tight/100,2)*195075 AS t FROM sk WHERE a<>0 AND {_OWN}<=pow((tight+3)/100,2)*195075),
 d AS (SELECT image_id, x, y, CASE WHEN t THEN 0 ELSE 1 END AS depth FROM k WHERE x IN (0,63) OR y IN (0,63)
  UNION SELECT k.image_id, k.x, k.y, CASE WHEN k.t THEN 0 ELSE d.depth+1 END FROM d {_STEP} JOIN k ON k.image_id=d.image_id AND k.x=d.x+o.dx AND k.y=d.y+o.dy WHERE k.t OR d.depth<1),
 f AS (SELECT DISTINCT image_id, x, y FROM d), er AS (SELECT s.image_id, s.x, s.y, r, g, b, CASE WHEN f.x IS NULL THEN a ELSE 0 END AS a, br, bg, bb FROM sk s LEFT JOIN f ON f.image_id=s.image_id AND f.x=s.x AND f.y=s.y), """
add("run_smart_erase_scene", on("scene", lambda d: digest(PL.smart_erase_auto(d, lambda x: settled(x, "bg")))), src("scene", _AUTO + decon_ctes("er", "dc", 0.4, ("br", "bg", "bb")), True) + digest_sql("dc"))
add("handle_tap_scene", on("scene", lambda d: digest(PL.tap(d, d, "erase", "#ffffff", _seeds(d)))), src("scene", _SEED.split(",\n go AS")[0].replace("pow(0.12,2)", "pow(0.06,2)") + ", f AS (SELECT * FROM sf), " + _FLOODED, True) + digest_sql("res"))
add("handle_tap_restore_scene", on("scene", lambda d: digest(PL.tap(_white_strip(d), d, "restore", "#ffffff", _seeds(d)))), src("scene", _CUR + ", " + restore_ctes((255, 255, 255), 0.26, "solid", search=50)) + digest_sql("res"))


def _scaled(spark: SparkSession, sf: str) -> DataFrame:
    """event, partly erased, restored from an original of a quarter of its places."""
    d = raster(spark, sf, "event")
    cur = d.withColumn("a", F.when((F.col("x") + F.col("y")) % 3 == 0, 0).otherwise(F.col("a")))
    return digest(PL.restore_scaled(cur, d.where("x < 8 and y < 8"), (16, 16), "#8080c0", 40, 1, 2, "original"))


add("restore_color_scaled_event", _scaled, src("event", "cur AS (SELECT image_id, x, y, r, g, b, CASE WHEN (x+y)%3=0 THEN 0 ELSE a END AS a FROM src), og AS (SELECT * FROM src WHERE x<8 AND y<8), "
    + resample_ctes("og", 8, 16, "bilinear", "o2") + ", " + restore_ctes((128, 128, 192), 0.40, "original", "o2", 2)) + digest_sql("res"))
add("render_for_print_event", on("event", lambda d: digest(PL.render_for_print(d, (16, 16), (24, 24)))), src("event", resample_ctes("src", 16, 24, "lanczos3") + ", " + edge_sharpen_ctes("rs", "es", 0.4)) + digest_sql("es"))
add("vectorize_fallback_event", on("event", lambda d: digest(PL.vectorize_colour(d, "#8050c0", (16, 16), (32, 32), tolerance=90))),
    src("event", "ms AS (SELECT image_id, x, y, 128 AS r, 80 AS g, 192 AS b, CASE WHEN a>=128 AND (r-128)*(r-128)+(g-80)*(g-80)+(b-192)*(b-192)<=90*90 THEN 255 ELSE 0 END AS a FROM src), " + resample_ctes("ms", 16, 32, "bilinear")) + digest_sql("rs"))
_NOISE = ", ".join(f"CASE WHEN {_WHITE}<200 THEN CAST(least(255, greatest(0, {c}+((CAST(image_id AS BIGINT)*7919+x*104729+y*1299709+{k}*15485863)%65521*40503%65521)%13-6)) AS INTEGER) ELSE {c} END AS {c}" for k, c in enumerate("rgb"))
add("background_noise_event", on("event", lambda d: digest(P.noise_near_white(d))), src("event", f"ns AS (SELECT image_id, x, y, {_NOISE}, a FROM src)") + digest_sql("ns"))
add("background_noise_scene", on("scene", P.noise_near_white, digested=True), src("scene", f"ns AS (SELECT image_id, x, y, {_NOISE}, a FROM src)") + digest_sql("ns"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PL.design_summary(raster(spark, sf_dir, "scene"))


add("design_summary_scene", flagship, src("scene", _BG + ", " + flood_ctes(_W3, "f") + ", " + _FLOODED, True) + f"""SELECT image_id, color AS background, removed, kept, enclosed FROM bgc JOIN (SELECT image_id, count(*) FILTER (a=0) AS removed, count(*) FILTER (a<>0) AS kept,
 count(*) FILTER (a<>0 AND {_WHITE}<=pow(0.03,2)*195075) AS enclosed FROM res GROUP BY image_id) USING (image_id)""")

# -- catalogs, presets, layers -------------------------------------------------------------------------------------------------


def values(rows: list[tuple], names: str) -> str:
    def lit(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return f"CAST({v} AS DOUBLE)" if isinstance(v, float) else str(list(v)) if isinstance(v, list) else f"CAST({v} AS INTEGER)"

    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + f") t({names})"


add("repair_profiles", lambda s, d: L.repair_profiles(s), X.table(X.REPAIR_PROFILES, "id, name, tolerance, padding, search_radius, mode"))
add("print_presets", lambda s, d: L.print_presets(s), X.table(X.PRINT_PRESETS, "name, width_in, height_in, fit, description"))
add("common_print_sizes", lambda s, d: L.print_sizes(s), X.table(X.COMMON_PRINT_SIZES, "label, width_in, height_in"))
add("text_swatches", lambda s, d: L.swatches(s), X.table(X.TEXT_SWATCHES, "label, hex"))
add("critique_catalog", lambda s, d: Q.critiques(s), X.table(X.CRITIQUES, "id, label, description, grp"))
add("keyword_rules", lambda s, d: Q.keyword_rules(s), X.table(X.KEYWORD_RULES, "priority, pattern, critique"))
add("font_registry", lambda s, d: L.fonts(s), X.table(X.FONTS, "id, label, category, weights, has_italic, size_factor"))
add("fonts_by_category", lambda s, d: L.fonts_by_category(s, "display").select("id"), "SELECT * FROM (VALUES ('cinzel'), ('cinzel-decorative'), ('playfair-display')) t(id)")
add("adjustment_presets", lambda s, d: L.adjustment_presets(s), X.table(X.ADJUSTMENTS, "kind, name, brightness, contrast, saturation, vibrance, sharpen, shadows, highlights, warmth, edge_cleanup, auto_levels"))


def _flat(p: DataFrame) -> DataFrame:
    return p.select("id", "name", "params.color", "params.tolerance", "params.strategy", "params.edge_feather", "params.finish.solid_edges", "params.finish.alpha_threshold", "params.finish.choke", "params.finish.despill")


_PRE = [(p[0], p[1], p[4], p[5], p[6], p[7], True, 128, p[8], True) for p in L.BG_REMOVAL_PRESETS]
_PN = "id, name, color, tolerance, strategy, edge_feather, solid_edges, alpha_threshold, choke, despill"
add("bg_removal_presets", lambda s, d: _flat(L.bg_removal_presets(s)), X.table(X.BG_REMOVAL_PRESETS, _PN))
add("preset_by_id", lambda s, d: _flat(L.preset_by_id(L.bg_removal_presets(s), "green-screen")), X.table(X.BG_REMOVAL_PRESETS, _PN) + " WHERE id='green-screen'")


def _stored(spark: SparkSession) -> DataFrame:
    """Customs: two new ones and a copy of a built-in."""
    b = L.bg_removal_presets(spark)
    mine = b.where("ordinal < 3").withColumns({"id": F.when(F.col("ordinal") == 2, F.col("id")).otherwise(F.concat(F.lit("custom-"), "id")), "custom": F.lit(True)})
    return mine


_MINE = [(p[0] if i == 2 else f"custom-{p[0]}", *p[1:]) for i, p in enumerate(_PRE[:3])]
add("all_presets", lambda s, d: L.all_presets(L.bg_removal_presets(s), _stored(s)).select("id", "origin"), values([(p[0], 0) for p in _PRE] + [(p[0], 1) for p in _MINE], "id, origin"))
add("preset_upsert", lambda s, d: L.upsert_preset(_stored(s), _stored(s).where("ordinal = 0").withColumn("name", F.lit("again"))).select("id", "name", "ordinal"), values([(_MINE[1][0], _MINE[1][1], 1), (_MINE[2][0], _MINE[2][1], 2), (_MINE[0][0], "again", 3)], "id, name, ordinal"))
add("preset_delete", lambda s, d: L.delete_preset(_stored(s), "logo-on-black").select("id"), values([(p[0],) for p in _MINE[:2]], "id"))
add("is_custom_preset", lambda s, d: L.all_presets(L.bg_removal_presets(s), _stored(s)).select("id", "origin", L.is_custom().alias("is_custom")), values([(p[0], 0, False) for p in _PRE] + [(p[0], 1, True) for p in _MINE], "id, origin, is_custom"))
_RAW = [
    ("valid", '[{"id":"a","name":"A","params":{"color":"#fff","tolerance":7}},{"id":"b","name":"B","params":{}}]'), ("object", '{"id":"a"}'), ("broken", "[{"), ("none", None),
    ("mixed", '[{"id":1,"name":"n","params":{}},{"name":"no id","params":{}},{"id":"c","name":"C","params":null},{"id":"d","name":"D","params":{"tolerance":3}}]'),
]
add("preset_parse", lambda s, d: L.parse_presets(s.createDataFrame(_RAW, "key string, json string")).select("key", "ordinal", "id", "name", F.col("params.tolerance").alias("tolerance")), values([("valid", 0, "a", "A", 7.0), ("valid", 1, "b", "B", None), ("mixed", 3, "d", "D", 3.0)], "key, ordinal, id, name, tolerance"))


def _layers(spark: SparkSession, sf: str) -> DataFrame:
    p = spark.read.parquet(f"{sf}/part.parquet").crossJoin(F.broadcast(L.fonts(spark).select(F.col("id").alias("fid"), F.monotonically_increasing_id().alias("fn")).where("fid in ('lato', 'cinzel')")))
    k = F.col("p_partkey")
    return p.where(((k % 2 == 0) & (F.col("fid") == "lato")) | ((k % 2 == 1) & (F.col("fid") == "cinzel"))).select(
        F.concat(F.lit("t"), k.cast("string")).alias("id"), F.when(k % 10 == 0, "").otherwise(F.col("p_name")).alias("text"), F.when(k % 7 == 0, "lost-font").otherwise(F.col("fid")).alias("font_id"), F.lit(400).alias("weight"), (k % 3 == 0).alias("italic"),
        (F.lit(10.0) + k % 20).cast("double").alias("size"), F.lit("#000000").alias("color"), F.lit("center").alias("align"), (k * 3 % 200).cast("double").alias("x"), (k * 5 % 300).cast("double").alias("y"), F.lit(0.0).alias("rotation"), F.when(k % 4 == 0, 2.0).alias("letter_spacing"),
    )


_LAY = "ly AS (SELECT p_partkey AS k, 't' || CAST(p_partkey AS VARCHAR) AS id, CASE WHEN p_partkey%10=0 THEN '' ELSE p_name END AS text, CASE WHEN p_partkey%7=0 THEN 'lost-font' WHEN p_partkey%2=0 THEN 'lato' ELSE 'cinzel' END AS font_id, CAST(10+p_partkey%20 AS DOUBLE) AS size, CAST(p_partkey*3%200 AS DOUBLE) AS x, CAST(p_partkey*5%300 AS DOUBLE) AS y FROM part)"
add("place_text_layers", lambda s, d: L.place_layers(_layers(s, d), L.fonts(s), (200, 300), (500, 600)).select("id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), F.round("font_px", 6).alias("font_px"), F.round("spacing_px", 6).alias("spacing_px")), f"WITH {_LAY} SELECT id, round(x*2.5,6) AS x, round(y*2.0,6) AS y, round(size*2.25,6) AS font_px, round(CASE WHEN k%4=0 THEN 2.0 ELSE 0.0 END*2.25,6) AS spacing_px FROM ly WHERE text<>'' AND font_id<>'lost-font'")
add("font_shorthand", lambda s, d: L.place_layers(_layers(s, d), L.fonts(s), (200, 300), (500, 600)).select("id", "font"), f"WITH {_LAY} SELECT id, CASE WHEN k%3=0 THEN 'italic' ELSE 'normal' END || ' 400 ' || regexp_replace(printf('%.4f', size*2.25), '\\.?0+$', '') || 'px ' || CASE font_id WHEN 'lato' THEN 'Lato' ELSE 'Cinzel' END AS font FROM ly WHERE text<>'' AND font_id<>'lost-font'")
add("unknown_fonts", lambda s, d: L.unknown_fonts(_layers(s, d), L.fonts(s)), f"WITH {_LAY} SELECT id, font_id FROM ly WHERE font_id='lost-font'")
add("patch_text_layers", lambda s, d: L.patch_layers(_layers(s, d), s.createDataFrame([("t1", "new", None), ("t2", None, 99.0)], "id string, text string, size double")).select("id", "text", "size"), f"WITH {_LAY} SELECT id, CASE id WHEN 't1' THEN 'new' ELSE text END AS text, CASE id WHEN 't2' THEN 99.0 ELSE size END AS size FROM ly")



def _edited(spark: SparkSession, sf: str) -> DataFrame:
    """Layers of part after additions, moves and deletions that are also rows of a table."""
    old = _layers(spark, sf).where(~F.col("id").endswith("3"))
    n = F.substring("id", 2, 9).cast("int")
    new = _layers(spark, sf).where(F.col("id").endswith("3"))
    moves = old.where(n % 4 == 0).select("id", (F.col("x") + 7.5).alias("x"), (F.col("y") - 2).alias("y"))
    gone = old.where(n % 5 == 1).select("id")
    return L.delete_layers(L.patch_layers(L.add_layers(old, new), moves), gone).select("id", "text", "x", "y")


add("edit_text_layers", _edited, f"WITH {_LAY} SELECT id, text, CASE WHEN k%10<>3 AND k%4=0 THEN x+7.5 ELSE x END AS x, CASE WHEN k%10<>3 AND k%4=0 THEN y-2 ELSE y END AS y FROM ly WHERE k%10=3 OR k%5<>1")

# -- critiques ---------------------------------------------------------------------------------------------------------------------

_PHRASES = [
    "the white inside got eaten", "there is a halo around it", "edges look jagged", "edges are nibbled and too thin", "it is blurry", "green on the edges", "removed too much of it", "the background is still showing",
    "not enough was taken", "the flowers are gone", "way too aggressive", "white letters inside are missing", "   ", "looks fine to me",
]
_EXPECT = "CASE o_orderkey%14 WHEN 0 THEN 'interior-lost,edge-shrunk' WHEN 1 THEN 'edge-halo' WHEN 2 THEN 'edge-jaggy' WHEN 3 THEN 'edge-shrunk' WHEN 4 THEN 'edge-soft' WHEN 5 THEN 'color-tint' WHEN 6 THEN 'amount-too-much' WHEN 7 THEN 'amount-not-enough' WHEN 8 THEN 'amount-not-enough' WHEN 9 THEN 'interior-lost' WHEN 10 THEN 'amount-too-much' WHEN 11 THEN 'interior-lost' ELSE '' END"


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", F.element_at(F.array(*map(F.lit, _PHRASES)), (F.col("o_orderkey") % 14 + 1).cast("int")).alias("text"))


add("critique_parse_orders", lambda s, d: _texts(s, d).select("o_orderkey", F.concat_ws(",", Q.parse_critique(F.col("text"))).alias("critiques")), f"SELECT o_orderkey, {_EXPECT} AS critiques FROM orders")


def critique_sql(text: str) -> str:
    """The rules by DuckDB's own regular expressions, whose word border is ASCII."""
    rules = X.KEYWORD_RULES
    return f"(SELECT k, string_agg(c, ',' ORDER BY i) AS critiques FROM (SELECT k, c, min(i) AS i FROM ({text}) t JOIN (VALUES {rules}) r(i, p, c) ON regexp_matches(txt, '(?i)' || p) WHERE trim(txt)<>'' GROUP BY k, c) GROUP BY k)"


for _t, _k in (("documents", "doc_id"), ("benchmark", "item_id")):
    add(f"critique_parse_{_t}", lambda s, d, t=_t, k=_k: s.read.parquet(f"{d}/{t}.parquet").select(k, F.concat_ws(",", Q.parse_critique(F.col("text"))).alias("critiques")), f"SELECT {_k}, coalesce(critiques, '') AS critiques FROM {_t} LEFT JOIN {critique_sql(f'SELECT {_k} AS k, text AS txt FROM {_t}')} m ON m.k={_k}")
add("critique_parse_conversations", lambda s, d: s.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", F.concat_ws(",", Q.parse_critique(F.col("text"))).alias("critiques")), f"SELECT conv_id, turn, coalesce(critiques, '') AS critiques FROM conversations LEFT JOIN {critique_sql('SELECT conv_id*100000+turn AS k, text AS txt FROM conversations')} m ON m.k=conv_id*100000+turn")


def _params(spark: SparkSession, sf: str) -> DataFrame:
    o = spark.read.parquet(f"{sf}/orders.parquet")
    k = F.col("o_orderkey")
    finish = F.struct((k % 2 == 0).alias("solid_edges"), (k % 254 + 1).cast("int").alias("alpha_threshold"), (k % 6).cast("int").alias("choke"), (k % 3 == 0).alias("despill"))
    p = F.struct(F.lit("#ffffff").alias("color"), (k % 51).cast("double").alias("tolerance"), F.when(k % 5 < 3, "flood").otherwise("global").alias("strategy"), (k % 6).cast("double").alias("edge_feather"), finish.alias("finish"))
    c = F.element_at(F.array(*[F.lit(x[0]) for x in Q.CRITIQUES]), (k % 9 + 1).cast("int"))
    return o.select("o_orderkey", p.alias("p"), c.alias("c"))


_PAR = "pr AS (SELECT o_orderkey, o_orderkey%9 AS c, CAST(o_orderkey%51 AS DOUBLE) AS t, CASE WHEN o_orderkey%5<3 THEN 'flood' ELSE 'global' END AS s, CAST(o_orderkey%6 AS DOUBLE) AS f, o_orderkey%2=0 AS so, o_orderkey%254+1 AS th, o_orderkey%6 AS ck, o_orderkey%3=0 AS ds FROM orders)"
_APPLIED = """SELECT o_orderkey, CASE WHEN c=0 THEN least(50.0, t+CASE WHEN t<15 THEN 4 ELSE 3 END) WHEN c=1 THEN greatest(0.0, t-3) WHEN c=2 AND s='flood' THEN greatest(0.0, t-2) ELSE t END AS tolerance,
 CASE WHEN c=2 THEN 'flood' ELSE s END AS strategy, CASE WHEN c=4 THEN least(5.0, f+1) WHEN c=6 THEN greatest(0.0, f-1) ELSE f END AS edge_feather, CASE WHEN c IN (3,6) THEN true ELSE so END AS solid_edges,
 CAST(CASE WHEN c=3 THEN least(254, th+16) WHEN c=5 THEN greatest(1, th-16) ELSE th END AS INTEGER) AS alpha_threshold, CAST(CASE WHEN c=3 THEN least(5, ck+1) WHEN c IN (1,5) THEN greatest(0, ck-1) ELSE ck END AS INTEGER) AS choke,
 CASE WHEN c=7 THEN true WHEN c=8 THEN false ELSE ds END AS despill FROM pr"""
_PCOLS = ["n.tolerance", "n.strategy", "n.edge_feather", "n.finish.solid_edges", "n.finish.alpha_threshold", "n.finish.choke", "n.finish.despill"]
add("critique_apply_orders", lambda s, d: _params(s, d).select("o_orderkey", Q.apply_critique(F.col("p"), F.col("c")).alias("n")).select("o_orderkey", *_PCOLS), f"WITH {_PAR} {_APPLIED}")
add("critique_fold_orders", lambda s, d: _params(s, d).select("o_orderkey", Q.apply_critiques(F.col("p"), F.array("c")).alias("n")).select("o_orderkey", *_PCOLS), f"WITH {_PAR} {_APPLIED}")


def _fold_sql(most: int = 4) -> str:
    """Two to four critiques in turn; -1 changes nothing."""
    out, at = _PAR, "pr"
    for i in range(most):
        nxt = f"(SELECT o_orderkey, CASE WHEN {i + 1}<2+o_orderkey%3 THEN (o_orderkey+4*{i + 1})%9 ELSE -1 END AS c, tolerance AS t, strategy AS s, edge_feather AS f, solid_edges AS so, alpha_threshold AS th, choke AS ck, despill AS ds FROM ({_APPLIED.replace('FROM pr', 'FROM ' + at)}))"
        out, at = f"{out}, p{i} AS {nxt}", f"p{i}"
    return f"WITH {out} SELECT o_orderkey, t AS tolerance, s AS strategy, f AS edge_feather, so AS solid_edges, th AS alpha_threshold, ck AS choke, ds AS despill FROM {at}"


def _folded(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    names = F.array(*[F.lit(x[0]) for x in Q.CRITIQUES])
    ids = F.transform(F.sequence(F.lit(0), (k % 3 + 1).cast("int")), lambda i: F.element_at(names, ((k + 4 * i) % 9 + 1).cast("int")))
    return _params(spark, sf).select("o_orderkey", Q.apply_critiques(F.col("p"), ids).alias("n")).select("o_orderkey", *_PCOLS)


add("critique_fold_several_orders", _folded, _fold_sql())
_N = "CAST(CAST({} AS INTEGER) AS VARCHAR)"
_CHOKE, _THR = _N.format("greatest(0, ck-1)"), _N.format("greatest(1, th-16)")
add("critique_explain_orders", lambda s, d: _params(s, d).select("o_orderkey", Q.explain_critique(F.col("p"), F.col("c")).alias("explanation")), f"""WITH {_PAR} SELECT o_orderkey, CASE c
 WHEN 0 THEN 'tolerance +' || CASE WHEN t<15 THEN '4' ELSE '3' END || ' → ' || {_N.format("least(50, t+CASE WHEN t<15 THEN 4 ELSE 3 END)")} || '%' || CASE WHEN t>=25 AND s='flood' THEN ', (tip: at high tolerance, consider trying "Everywhere" strategy if bg is enclosed)' ELSE '' END
 WHEN 1 THEN 'tolerance −3 → ' || {_N.format("greatest(0, t-3)")} || '%' || CASE WHEN ck>0 THEN ', choke −1 → ' || {_CHOKE} || 'px' ELSE '' END
 WHEN 2 THEN CASE WHEN s<>'flood' THEN 'strategy → flood (preserves enclosed pixels)' ELSE 'tolerance −2 → ' || {_N.format("greatest(0, t-2)")} || '% (already flood)' END
 WHEN 3 THEN 'choke +1 → ' || {_N.format("least(5, ck+1)")} || 'px, threshold +16 → ' || {_N.format("least(254, th+16)")}
 WHEN 4 THEN 'feather +1 → ' || {_N.format("least(5, f+1)")} || 'px' WHEN 5 THEN 'choke −1 → ' || {_CHOKE} || 'px, threshold −16 → ' || {_THR}
 WHEN 6 THEN 'feather −1 → ' || {_N.format("greatest(0, f-1)")} || 'px, solid-edges enforced'
 WHEN 7 THEN CASE WHEN ds THEN 'despill already on (no further action)' ELSE 'auto-despill enabled' END
 ELSE CASE WHEN ds THEN 'auto-despill disabled (skipping extra step)' ELSE 'despill already off' END END AS explanation FROM pr""")


def _samples(spark: SparkSession, sf: str) -> DataFrame:
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    from pyspark.sql import Window as W

    seq = F.row_number().over(W.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_shipdate", "l_discount", "l_tax"))
    finish = F.struct((F.col("l_returnflag") != "N").alias("solid_edges"), (F.col("l_quantity") * 5).cast("int").alias("alpha_threshold"), (F.col("l_partkey") % 6).cast("int").alias("choke"), (F.col("l_linestatus") == "O").alias("despill"))
    colour = F.element_at(F.array(F.lit("#ffffff"), F.lit("#000000"), F.lit("#00b140")), (F.col("l_partkey") % 3 + 1).cast("int"))
    p = F.struct(colour.alias("color"), (F.col("l_quantity") % 51).cast("double").alias("tolerance"), F.when(F.col("l_partkey") % 2 == 0, "flood").otherwise("global").alias("strategy"), (F.col("l_partkey") % 6).cast("double").alias("edge_feather"), finish.alias("finish"))
    return li.select(F.col("l_suppkey").alias("group_id"), seq.alias("seq"), F.when(F.col("l_linenumber") != 1, p).alias("accepted"))


add("consensus_preset_lineitem", lambda s, d: Q.aggregate_samples(_samples(s, d), "group_id"), """WITH q AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_shipdate, l_discount, l_tax) AS seq FROM lineitem),
 a AS (SELECT * FROM q WHERE l_linenumber<>1), cc AS (SELECT l_suppkey, l_partkey%3 AS c, count(*) AS n, min(seq) AS f FROM a GROUP BY ALL), ct AS (SELECT l_suppkey, c FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, f) AS k FROM cc) WHERE k=1)
SELECT l_suppkey AS group_id, count(*) AS n_accepted, CASE WHEN count(*)=1 THEN max(l_quantity%51) ELSE floor(avg(l_quantity%51)+0.5) END AS tolerance, CASE WHEN count(*) FILTER (l_partkey%2=0)*2>=count(*) THEN 'flood' ELSE 'global' END AS strategy,
 CAST(CASE WHEN count(*)=1 THEN max(l_partkey%6) ELSE floor(avg(l_partkey%6)+0.5) END AS DOUBLE) AS edge_feather, count(*) FILTER (l_returnflag<>'N')*2>=count(*) AS solid_edges, CAST(floor(avg(CAST(l_quantity*5 AS INTEGER))+0.5) AS INTEGER) AS alpha_threshold,
 CAST(floor(avg(l_partkey%6)+0.5) AS INTEGER) AS choke, count(*) FILTER (l_linestatus='O')*2>=count(*) AS despill, any_value((['#ffffff','#000000','#00b140'])[c+1]) AS color FROM a JOIN ct USING (l_suppkey) GROUP BY l_suppkey""")

# -- history -----------------------------------------------------------------------------------------------------------------------


def _steps(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window as W

    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.select(F.col("user_id").alias("session_id"), (F.row_number().over(W.partitionBy("user_id").orderBy("event_id")) - 1).cast("int").alias("seq"), F.col("event_type").alias("label"))


def _pointer(steps: DataFrame) -> DataFrame:
    return steps.groupBy("session_id").agg(F.max("seq").alias("at"))


_ST = "st AS (SELECT user_id AS session_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id)-1 AS INTEGER) AS seq, event_type AS label FROM events), en AS (SELECT session_id, min(seq) AS lo, max(seq) AS hi FROM st GROUP BY session_id)"
add("history_cap_events", lambda s, d: H.capped(_steps(s, d), 20), f"WITH {_ST} SELECT st.session_id, seq, label FROM st JOIN en USING (session_id) WHERE seq>hi-20")
add("history_undo_events", lambda s, d: (lambda st_: H.current(st_, H.undo(st_, _pointer(st_))))(_steps(s, d)), f"WITH {_ST} SELECT st.session_id, seq, label FROM st JOIN en USING (session_id) WHERE seq=greatest(0, hi-1)")
add("history_push_events", lambda s, d: (lambda st_: H.push(st_, H.moved(st_, _pointer(st_), -3), st_.select("session_id", F.lit("new").alias("label")).distinct(), 20)[0])(_steps(s, d)), f"WITH {_ST}, k AS (SELECT st.session_id, seq, label FROM st JOIN en USING (session_id) WHERE seq<=greatest(0, hi-3) UNION ALL SELECT session_id, greatest(0, hi-3)+1, 'new' FROM en) SELECT session_id, seq, label FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS n FROM k) WHERE n<=20")
add("history_start_over_events", lambda s, d: H.start_over(_steps(s, d))[0], f"WITH {_ST} SELECT session_id, seq, label FROM st WHERE seq=0")
add("critique_undo_events", lambda s, d: H.pop(_steps(s, d)), f"WITH {_ST} SELECT st.session_id, seq, label FROM st JOIN en USING (session_id) WHERE seq<hi")
add("mask_snapshots_events", lambda s, d: H.mask_snapshots(_steps(s, d)), f"WITH {_ST} SELECT st.session_id, seq, label FROM st JOIN en USING (session_id) WHERE seq>hi-21")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
