"""Catalogs: small literal dimension tables, preset storage, layers and their edits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import color as C
from ..schema import PARAMS, PRESETS

# -- fixed values: the tables as they are served -----------------------------------------------------------

#: id, name, icon, description, color, tolerance, strategy, edge feather, choke; all have solid edges, threshold 128, despill.
BG_REMOVAL_PRESETS = [
    ("acrylic-invite", "Acrylic Invite", "💍", "White background removed but white details inside the design (flowers, dress, butterflies, lettering) are preserved. Tuned for quinceañera / sweet 16 / wedding invite artwork.", "#ffffff", 12.0, "flood", 1.0, 1),
    ("logo-on-white", "Logo on White", "🏷️", "Solid logo or graphic on a white background. Removes the white outside the logo and hardens edges for crisp DTF / sticker / decal print.", "#ffffff", 8.0, "flood", 0.0, 0),
    ("logo-on-black", "Logo on Black", "⬛", "Logo or design on a black background (e.g. a dark mockup or scanned tee). Removes the black around the artwork while keeping any black inside the design.", "#000000", 12.0, "flood", 1.0, 1),
    ("green-screen", "Green Screen", "🟢", "Photo or product shot on a green chroma key. Aggressive despill removes leftover green tint on edge pixels.", "#00b140", 22.0, "global", 1.0, 0),
    ("blue-screen", "Blue Screen", "🔵", "Photo or product shot on a blue chroma key. Despill removes leftover blue tint on edges.", "#0047ab", 22.0, "global", 1.0, 0),
]

#: id, name, tolerance, padding, search radius, mode.
REPAIR_PROFILES = [
    ("thin-text", "Thin Text / Script", 28, 1, 30, "solid"),
    ("soft-flower", "Soft Flower / Pastel", 18, 2, 80, "original"),
    ("light-dress", "Light Dress / Subject", 22, 2, 40, "original"),
    ("gold-crown", "Gold Crown / Metallic", 26, 2, 50, "original"),
    ("solid-shape", "Solid Shape", 20, 1, 60, "solid"),
]

#: name, width and height in inches (0 is automatic), fit, description.
PRINT_PRESETS = [
    ("Shirt Front", 12.0, 0.0, "contain", "12in wide, full chest"),
    ("Shirt Back", 12.0, 16.0, "contain", "12 × 16in"),
    ("Pocket", 4.0, 4.0, "contain", "4 × 4in left chest"),
    ("Sticker (S)", 3.0, 3.0, "contain", "3 × 3in"),
    ("Sticker (L)", 5.0, 5.0, "contain", "5 × 5in"),
    ("Hat", 4.5, 2.25, "contain", "4.5 × 2.25in front panel"),
    ("Mug Wrap", 8.5, 3.0, "contain", "8.5 × 3in"),
    ("A4 Paper", 8.27, 11.69, "contain", "Full sheet"),
]

#: label, width and height in inches (0 keeps the source's size).
COMMON_PRINT_SIZES = [
    ("4 × 6 in (acrylic mini)", 4.0, 6.0),
    ("5 × 7 in (acrylic standard)", 5.0, 7.0),
    ("6 × 9 in (acrylic large)", 6.0, 9.0),
    ("8 × 10 in (acrylic XL)", 8.0, 10.0),
    ("Source size (no resize)", 0.0, 0.0),
]

#: id, label, category, weights, italic, size factor.
FONT_REGISTRY = [
    ("allura", "Allura", "script", [400], False, 0.13),
    ("great-vibes", "Great Vibes", "script", [400], False, 0.13),
    ("pinyon-script", "Pinyon Script", "script", [400], False, 0.13),
    ("italianno", "Italianno", "script", [400], False, 0.16),
    ("petit-formal-script", "Petit Formal Script", "script", [400], False, 0.12),
    ("alex-brush", "Alex Brush", "script", [400], False, 0.14),
    ("sacramento", "Sacramento", "script", [400], False, 0.12),
    ("yellowtail", "Yellowtail", "script", [400], False, 0.12),
    ("parisienne", "Parisienne", "script", [400], False, 0.12),
    ("tangerine", "Tangerine", "script", [400, 700], False, 0.16),
    ("dancing-script", "Dancing Script", "script", [400, 600, 700], False, 0.11),
    ("pacifico", "Pacifico", "script", [400], False, 0.10),
    ("cinzel", "Cinzel", "display", [400, 600, 700], False, 0.06),
    ("cinzel-decorative", "Cinzel Decorative", "display", [400, 700], False, 0.06),
    ("playfair-display", "Playfair Display", "display", [400, 600, 700], True, 0.07),
    ("cormorant-garamond", "Cormorant Garamond", "body", [400, 500, 600, 700], True, 0.035),
    ("eb-garamond", "EB Garamond", "body", [400, 500, 600, 700], True, 0.035),
    ("crimson-text", "Crimson Text", "body", [400, 600, 700], True, 0.035),
    ("cardo", "Cardo", "body", [400, 700], True, 0.035),
    ("montserrat", "Montserrat", "body", [300, 400, 500, 600, 700], False, 0.03),
    ("lato", "Lato", "body", [300, 400, 700], False, 0.03),
]

#: label, hex.
COMMON_TEXT_SWATCHES = [
    ("Antique gold", "#b8956a"), ("Champagne", "#d4b97a"), ("Rose gold", "#c08a7a"), ("Dusty rose", "#c87a93"),
    ("Blush", "#dca7b3"), ("Sage", "#8aa686"), ("Hunter green", "#5a7a5a"), ("Navy", "#1a2a4f"),
    ("Charcoal", "#2c2c2c"), ("Black", "#000000"), ("White", "#ffffff"), ("Ivory", "#fbf6e8"),
]

#: Adjustment presets: photo and graphic, automatic and neutral.
PHOTO_AUTO = {"brightness": 5, "contrast": 12, "saturation": 8, "vibrance": 18, "sharpen": 25, "shadows": 18, "highlights": -10, "warmth": 4, "auto_levels": True}
GRAPHIC_AUTO = {"contrast": 15, "vibrance": 25, "sharpen": 35, "edge_cleanup": 20}
PHOTO_NEUTRAL = {"brightness": 0, "contrast": 0, "saturation": 0, "vibrance": 0, "sharpen": 0, "shadows": 0, "highlights": 0, "warmth": 0, "auto_levels": False}
GRAPHIC_NEUTRAL = {"contrast": 0, "vibrance": 0, "sharpen": 0, "edge_cleanup": 0}


# -- tables --------------------------------------------------------------------------------------------------


def bg_removal_presets(spark: SparkSession) -> DataFrame:
    rows = [
        (i, p[0], p[1], p[2], p[3], (p[4], p[5], p[6], p[7], (True, 128, p[8], True)), False, None, None)
        for i, p in enumerate(BG_REMOVAL_PRESETS)
    ]
    return spark.createDataFrame(rows, PRESETS)


def repair_profiles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REPAIR_PROFILES, "id string, name string, tolerance int, padding int, search_radius int, mode string")


def print_presets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRINT_PRESETS, "name string, width_in double, height_in double, fit string, description string")


def print_sizes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(COMMON_PRINT_SIZES, "label string, width_in double, height_in double")


def fonts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FONT_REGISTRY, "id string, label string, category string, weights array<int>, has_italic boolean, size_factor double")


def fonts_by_category(spark: SparkSession, category: str) -> DataFrame:
    return fonts(spark).where(F.col("category") == category)


def swatches(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(COMMON_TEXT_SWATCHES, "label string, hex string")


def adjustment_presets(spark: SparkSession) -> DataFrame:
    """kind, name and every setting; a setting that a kind lacks is null."""
    rows = [("photo", "auto", PHOTO_AUTO), ("photo", "neutral", PHOTO_NEUTRAL), ("graphic", "auto", GRAPHIC_AUTO), ("graphic", "neutral", GRAPHIC_NEUTRAL)]
    names = ["brightness", "contrast", "saturation", "vibrance", "sharpen", "shadows", "highlights", "warmth", "edge_cleanup"]
    return spark.createDataFrame([(k, n, *[v.get(c) for c in names], v.get("auto_levels")) for k, n, v in rows], "kind string, name string, " + ", ".join(f"{c} int" for c in names) + ", auto_levels boolean")


# -- presets: parse, upsert, delete, list ----------------------------------------------------------------------

_STORED = f"id string, name string, icon string, description string, params {PARAMS}, custom boolean, created_at string, notes string"


def parse_presets(raw: DataFrame) -> DataFrame:
    """raw (key, json) to one row for each valid element, with ordinal; null, invalid or non-array JSON gives none.

    An element is valid if its id and name are JSON strings and its params an object.
    """
    items = raw.select("key", F.from_json("json", "array<string>").alias("items")).where("items is not null").select("key", F.posexplode("items").alias("ordinal", "item"))
    kind = lambda f: F.get_json_object("item", f"$.{f}")
    typed = F.from_json("item", _STORED)
    # from_json turns numbers into strings: the text of the element tells a string
    text = lambda f: F.col("item").rlike(rf'"{f}"\s*:\s*"')
    ok = kind("id").isNotNull() & text("id") & kind("name").isNotNull() & text("name") & F.trim(kind("params")).startswith("{")
    return items.where(ok).select("key", "ordinal", typed.alias("p")).select("key", "ordinal", "p.*")


def upsert_preset(presets: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``new`` replace those with their id and stand at the end."""
    last = presets.agg(F.coalesce(F.max("ordinal"), F.lit(-1)).alias("last"))
    added = new.crossJoin(F.broadcast(last)).withColumn("ordinal", (F.col("last") + F.row_number().over(W.orderBy("ordinal"))).cast("int")).drop("last")
    return presets.join(new.select("id"), "id", "left_anti").unionByName(added.select(presets.columns))


def delete_preset(presets: DataFrame, preset_id: str) -> DataFrame:
    return presets.where(F.col("id") != preset_id)


def all_presets(built_in: DataFrame, custom: DataFrame) -> DataFrame:
    """Built-in ones, then custom ones; equal ids stay twice."""
    return built_in.withColumn("origin", F.lit(0)).unionByName(custom.withColumn("origin", F.lit(1)), allowMissingColumns=True)


def preset_by_id(presets: DataFrame, preset_id: str) -> DataFrame:
    return presets.where(F.col("id") == preset_id)


def is_custom():
    return F.coalesce(F.col("custom"), F.lit(False))


# -- text layers -----------------------------------------------------------------------------------------------


def patch_layers(layers: DataFrame, patches: DataFrame) -> DataFrame:
    """Fields of a patch that are not null replace the layer's; id stays."""
    p = patches.select("id", *[F.col(c).alias(f"p_{c}") for c in patches.columns if c != "id"])
    have = set(patches.columns)
    return layers.join(p, "id", "left").select(*[F.coalesce(f"p_{c}", c).alias(c) if c in have and c != "id" else F.col(c) for c in layers.columns])


def add_layers(layers: DataFrame, new: DataFrame) -> DataFrame:
    """``layers`` and the new ones; a new one whose id is there already is left out (ids are the caller's)."""
    return layers.unionByName(new.join(layers.select("id"), "id", "left_anti").select(layers.columns))


def delete_layers(layers: DataFrame, ids: DataFrame) -> DataFrame:
    return layers.join(ids.select("id"), "id", "left_anti").select(layers.columns)


def place_layers(layers: DataFrame, font_table: DataFrame, source: tuple[int, int], target: tuple[int, int]) -> DataFrame:
    """Where each drawable layer stands on a target: empty texts and unknown fonts are skipped."""
    sx, sy = target[0] / source[0], target[1] / source[1]
    scale = (sx + sy) / 2
    known = layers.where(F.length("text") > 0).join(F.broadcast(font_table.select(F.col("id").alias("font_id"), F.col("label").alias("family"))), "font_id")
    px = F.col("size") * scale
    return known.select("id", "text", (F.col("x") * sx).alias("x"), (F.col("y") * sy).alias("y"), px.alias("font_px"), (F.coalesce("letter_spacing", F.lit(0.0)) * scale).alias("spacing_px"), C.font_shorthand(F.col("italic"), F.col("weight"), px, F.col("family")).alias("font"), "color", "align", "rotation")


def unknown_fonts(layers: DataFrame, font_table: DataFrame) -> DataFrame:
    return layers.join(font_table.select(F.col("id").alias("font_id")), "font_id", "left_anti").select("id", "font_id")
