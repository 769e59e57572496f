"""Named pipelines: operators in the order a user would apply them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import color as C
from ..operators import aggregate as A
from ..operators import detect as D
from ..operators import geometry as G
from ..operators import graph as R
from ..operators import kernels as K
from ..operators import point as P
from ..operators import window as N


def enhance_photo(df: DataFrame, adj: dict) -> DataFrame:
    """Levels, shadows and highlights, warmth, brightness and contrast, saturation, vibrance, sharpening; bytes after each."""
    if adj["auto_levels"]:
        df = A.auto_levels(df)
    df = P.shadow_highlight(df, adj["shadows"], adj["highlights"])
    df = P.warmth(df, adj["warmth"])
    df = P.brightness_contrast(df, adj["brightness"], adj["contrast"])
    df = P.saturate(df, adj["saturation"])
    df = P.vibrance(df, adj["vibrance"])
    return N.sharpen(df, adj["sharpen"] / 100) if adj["sharpen"] > 0 else df


def enhance_graphic(df: DataFrame, adj: dict) -> DataFrame:
    df = P.vibrance(P.brightness_contrast(df, 0, adj["contrast"]), adj["vibrance"])
    df = P.clean_alpha_edges(df, adj["edge_cleanup"] / 100)
    return N.sharpen(df, adj["sharpen"] / 100) if adj["sharpen"] > 0 else df


def chromakey(df: DataFrame, color: str, tolerance: float, strategy: str, edge_feather: float = 1) -> DataFrame:
    if strategy != "global":
        return R.flood_fill(df, color, tolerance, feather=edge_feather)
    df = P.chromakey_global(df, color, tolerance)
    return N.feather_alpha(df, edge_feather) if edge_feather > 0 else df


def dtf_finish(df: DataFrame, finish: dict, removed_color: str | None = None, *, tiles: bool = False) -> DataFrame:
    if finish["despill"] and removed_color:
        df = P.despill(df, removed_color)
    return N.alpha_threshold(df, finish["alpha_threshold"], finish["choke"], tiles=tiles) if finish["solid_edges"] else df


def trainer_pipeline(df: DataFrame, params: dict) -> DataFrame:
    """Chroma key, then the print finish."""
    df = chromakey(df, params["color"], params["tolerance"], params["strategy"], params["edge_feather"])
    return dtf_finish(df, params["finish"], params["color"], tiles=True)


def smart_erase_auto(df: DataFrame, settle: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame:
    """Background and noise are measured for each image and go with its pixels, so all images are erased by one plan."""
    tight = C.clamp(C.half_up(F.col("noise") + 2), 3, 6).cast("int").alias("tight")
    own = [c.alias(n) for c, n in zip(C.hex_channels(F.col("color")), ("ground_r", "ground_g", "ground_b"), strict=True)]
    d = df.join(settle(A.analyze_background(df).select("image_id", *own, tight)), "image_id")
    ground = tuple(F.col(f"ground_{c}") for c in "rgb")
    out = R.smart_erase(d, ground, F.col("tight"), F.col("tight") + 3, 1)
    return N.decontaminate_edges(out, ground, 0.4, 1, 3).select(df.columns)


def remove_all_background(df: DataFrame, color: str) -> DataFrame:
    """Enclosed holes too, behind walls of up to 14 pixels."""
    return R.remove_enclosed_holes(df, color, 3, 14)


def tap(df: DataFrame, original: DataFrame, action: str, color: str, seeds: DataFrame, mode: str = "solid") -> DataFrame:
    """One tap: erase the region there, or restore its colour from the original."""
    if action == "erase":
        return R.erase_region(df, seeds, 6, 0)
    return N.restore_color(df, original, color, 26 if mode == "solid" else 22, 1, 50, mode).drop("restored")


def restore_scaled(df: DataFrame, original: DataFrame, size: tuple[int, int], color: str, tolerance: float, padding: int, search_radius: int, mode: str) -> DataFrame:
    """Restoring from an original of another size: it is brought to ``size``, that of ``df``, first."""
    return N.restore_color(df, K.resize_images(original, *size, "stretch"), color, tolerance, padding, search_radius, mode).drop("restored")


def extract_from_screenshot(df: DataFrame, settle: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame:
    """Design pixels of the images that show a checkerboard, cropped, checker erased; other images give no rows."""
    spec = settle(D.detect_checkerboard(df))
    return D.remove_checkerboard(D.crop_to_boxes(df, D.design_box(df, spec)), spec)


def render_for_print(df: DataFrame, source: tuple[int, int], target: tuple[int, int], *, sharpen: float = 0.4, tracer=None, most_colours: int = 3) -> DataFrame:
    """Lanczos resampling, then letterforms from ``tracer(df, colours) -> (pixels, masks)`` if one is given, then sharpening."""
    out = G.resample(df, source, target) if source != target else df
    if tracer is not None:
        overlays = tracer(df, D.detect_text_colours(df, most_colours))
        if overlays is not None:
            out = D.compose_overlays(out, overlays, source, target)
    return N.edge_aware_sharpen(out, sharpen) if sharpen > 0 else out


def design_summary(df: DataFrame) -> DataFrame:
    """image_id, background, removed, kept, enclosed: what is left of a design after its white ground goes."""
    bg = A.analyze_background(df).select("image_id", F.col("color").alias("background"))
    out = R.flood_fill(df, "#ffffff", 3)
    white = C.dist_sq("#ffffff") <= C.max_dist_sq(3)
    n = out.groupBy("image_id").agg(F.count_if(F.col("a") == 0).alias("removed"), F.count_if(F.col("a") != 0).alias("kept"), F.count_if((F.col("a") != 0) & white).alias("enclosed"))
    return bg.join(n, "image_id")


# -- hooks: what needs software that is not part of this engine ---------------------------------------------------


def remove_background_ai(images: DataFrame, model: Callable | None = None) -> DataFrame:
    """``model`` takes and gives an iterator of pandas frames of images (RGBA bytes)."""
    if model is None:
        raise NotImplementedError("no segmentation model is built in: pass one as model")
    return images.mapInPandas(model, images.schema)


def vectorize_colour(df: DataFrame, color: str, source: tuple[int, int], target: tuple[int, int], tracer: Callable | None = None, tolerance: float = 18) -> DataFrame:
    """Pixels of one colour at target size: traced by ``tracer(mask)``, or else the mask resampled."""
    mask = D.colour_mask(df, color, tolerance)
    if tracer is not None:
        return tracer(mask)
    r, g, b = C.hex_ints(color)
    flat = mask.select("image_id", "x", "y", F.lit(r).alias("r"), F.lit(g).alias("g"), F.lit(b).alias("b"), (F.col("m") * 255).alias("a"))
    return G.resample(flat, source, target, "bilinear")


def render_text_layers(placed: DataFrame, rasterizer: Callable | None = None) -> DataFrame:
    """``placed`` comes from ``catalog.place_layers``; glyphs need a rasterizer of the caller."""
    if rasterizer is None:
        raise NotImplementedError("no glyph rasterizer is built in: pass one as rasterizer")
    return rasterizer(placed)


acrylic_preview = K.acrylic_preview
