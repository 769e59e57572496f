"""Critique rules: free text to critiques, critiques to parameter changes, samples to a consensus."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# -- fixed values ------------------------------------------------------------------------------------------------

#: id, label, description, group.
CRITIQUES = [
    ("amount-not-enough", "Background still showing", "Not enough was removed — increase tolerance.", "amount"),
    ("amount-too-much", "Removed too much of the design", "The subject lost pixels — decrease tolerance / unchoke.", "amount"),
    ("interior-lost", "White inside the design got eaten", "Switch to flood-fill so only edge-connected background is removed; preserves white inside flowers/dress/letters.", "interior"),
    ("edge-halo", "Fuzzy halo / fringe on edges", "Increase edge choke and threshold to harden cutout edges.", "edges"),
    ("edge-jaggy", "Jagged stair-step edges", "Increase feather to soften before thresholding.", "edges"),
    ("edge-shrunk", "Edges nibbled too thin", "Reduce choke and lower threshold so more edge pixels stay.", "edges"),
    ("edge-soft", "Edges look too soft / blurry", "Reduce feather and ensure solid-edge thresholding is on.", "edges"),
    ("color-tint", "Color tint on edges", "Enable auto-despill — neutralizes leftover green/blue/red on edge pixels.", "color"),
    ("color-tint-clean", "Edges look clean (no tint)", "Despill not needed — disable to skip extra processing.", "color"),
]

#: The rules in order of priority: pattern (ASCII word borders, any case), critique.
KEYWORD_RULES = [
    (r"\b(inside|interior|inner|within|center|middle)\b.*\b(white|light|gone|removed|missing|lost|eaten|disappear)", "interior-lost"),
    (r"\b(white|light)\b.*\b(inside|interior|inner|within)\b.*\b(gone|removed|missing|lost|eaten|disappear)", "interior-lost"),
    (r"\b(flowers?|dress|butterfl(y|ies)|letters?|crown|hair)\b.*\b(white|gone|removed|missing|lost|eaten|disappear)", "interior-lost"),
    (r"\b(halo|fringe|fuzzy|fuzz|glow|aura|outline.*background|ghost)\b", "edge-halo"),
    (r"\b(jagged|jaggy|jaggies|stair|aliased|pixelated edges?|stepped)\b", "edge-jaggy"),
    (r"\b(nibbled|chewed|eaten|bitten|too small|shrunk|shrank|outline lost|too thin|chopped)\b", "edge-shrunk"),
    (r"\b(blurr?y|smudged?|too soft|soft edges?|fuzzy soft)\b", "edge-soft"),
    (r"\b(tint(ed)?|spill|colou?r.*edges?|green.*edges?|yellow.*edges?|gray.*edges?|blue.*edges?)\b", "color-tint"),
    (r"\b(removed|deleted|gone|missing).{0,30}\b(too much|too many|much of|subject|design|all)\b", "amount-too-much"),
    (r"\b(too aggressive|over.?(removed|did)|ate the (design|subject))", "amount-too-much"),
    (r"\b(background|bg).{0,30}\b(still|left|visible|shown|showing|remain|there)", "amount-not-enough"),
    (r"\b(not enough|didn'?t remove|need.*more|missed (some|spots))", "amount-not-enough"),
]

_KEPT = ("inside", "interior", "inner", "within")
_LOST = ("gone", "removed", "missing", "lost", "eaten", "disappear")
#: For each rule, literals of which a matching text holds one of every group, whatever the case.
KEYWORD_GATES = [
    [(*_KEPT, "center", "middle"), ("white", "light", *_LOST)],
    [("white", "light"), _KEPT, _LOST],
    [("flower", "dress", "butterfl", "letter", "crown", "hair"), ("white", *_LOST)],
    [("halo", "fringe", "fuzz", "glow", "aura", "outline", "ghost")],
    [("jagg", "stair", "aliased", "pixelated", "stepped")],
    [("nibbled", "chewed", "eaten", "bitten", "too small", "shr", "outline lost", "too thin", "chopped")],
    [("blur", "smudge", "soft")],
    [("tint", "spill", "edge")],
    [("removed", "deleted", "gone", "missing"), ("too m", "much of", "subject", "design", "all")],
    [("too aggressive", "over", "ate the ")],
    [("background", "bg"), ("still", "left", "visible", "show", "remain", "there")],
    [("not enough", "t remove", "need", "missed ")],
]

#: A word border between ASCII letters, digits and underscore and anything else, as a Java pattern.
BORDER = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def critiques(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CRITIQUES, "id string, label string, description string, grp string")


def keyword_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *r) for i, r in enumerate(KEYWORD_RULES)], "priority int, pattern string, critique string")


def parse_critique(text: Column) -> Column:
    """array<string>: the critiques whose rules match, each once, by the priority of its first rule; blank gives none.

    Twelve fixed patterns become one expression: no join, and each row is read once. A pattern is tried only on texts that
    hold its literals.
    """

    def hits(low: Column) -> Column:
        out = []
        for (pattern, critique), groups in zip(KEYWORD_RULES, KEYWORD_GATES, strict=True):
            gate = reduce(and_, [reduce(or_, [low.contains(w) for w in words]) for words in groups])
            out.append(F.when(gate & text.rlike("(?i)" + pattern.replace(r"\b", BORDER)), F.lit(critique)))
        return F.array(*out)

    found = F.array_distinct(F.array_compact(F.transform(F.array(F.lower(text)), hits)[0]))
    return F.when(text.isNull() | (F.trim(text) == ""), F.array().cast("array<string>")).otherwise(found)


def _held(v: Column, lo: float, hi: float) -> Column:
    return F.least(F.lit(hi), F.greatest(F.lit(lo), v))


def apply_critique(p: Column, critique: Column) -> Column:
    """The parameters after one critique."""
    fin = p["finish"]

    def is_(*names: str) -> Column:
        return critique.isin(*names)

    flood = p["strategy"] == "flood"
    tolerance = (
        F.when(is_("amount-not-enough"), _held(p["tolerance"] + F.when(p["tolerance"] < 15, 4.0).otherwise(3.0), 0.0, 50.0))
        .when(is_("amount-too-much"), _held(p["tolerance"] - 3, 0.0, 50.0))
        .when(is_("interior-lost") & flood, _held(p["tolerance"] - 2, 0.0, 50.0))
        .otherwise(p["tolerance"])
    )
    strategy = F.when(is_("interior-lost"), F.lit("flood")).otherwise(p["strategy"])
    feather = F.when(is_("edge-jaggy"), _held(p["edge_feather"] + 1, 0.0, 5.0)).when(is_("edge-soft"), _held(p["edge_feather"] - 1, 0.0, 5.0)).otherwise(p["edge_feather"])
    solid = F.when(is_("edge-halo", "edge-soft"), True).otherwise(fin["solid_edges"])
    threshold = F.when(is_("edge-halo"), _held(fin["alpha_threshold"] + 16, 1, 254)).when(is_("edge-shrunk"), _held(fin["alpha_threshold"] - 16, 1, 254)).otherwise(fin["alpha_threshold"])
    choke = (
        F.when(is_("edge-halo"), _held(fin["choke"] + 1, 0, 5))
        .when(is_("edge-shrunk"), _held(fin["choke"] - 1, 0, 5))
        .when(is_("amount-too-much") & (fin["choke"] > 0), _held(fin["choke"] - 1, 0, 5))
        .otherwise(fin["choke"])
    )
    despill = F.when(is_("color-tint"), True).when(is_("color-tint-clean"), False).otherwise(fin["despill"])
    finish = F.struct(solid.alias("solid_edges"), threshold.cast("int").alias("alpha_threshold"), choke.cast("int").alias("choke"), despill.alias("despill"))
    return F.struct(p["color"].alias("color"), tolerance.alias("tolerance"), strategy.alias("strategy"), feather.alias("edge_feather"), finish.alias("finish"))


def _shown(v: Column) -> Column:
    return F.regexp_replace(v.cast("string"), r"\.0$", "")


def explain_critique(p: Column, critique: Column) -> Column:
    """What a critique changed, as one line of text; the wording is fixed."""
    n = apply_critique(p, critique)
    fin, nfin = p["finish"], n["finish"]
    step = F.when(p["tolerance"] < 15, "4").otherwise("3")
    not_enough = F.concat(F.lit("tolerance +"), step, F.lit(" → "), _shown(n["tolerance"]), F.lit("%"))
    hint = F.lit(', (tip: at high tolerance, consider trying "Everywhere" strategy if bg is enclosed)')
    return (
        F.when(critique == "amount-not-enough", F.when((p["tolerance"] >= 25) & (p["strategy"] == "flood"), F.concat(not_enough, hint)).otherwise(not_enough))
        .when(critique == "amount-too-much", F.concat_ws(", ", F.concat(F.lit("tolerance −3 → "), _shown(n["tolerance"]), F.lit("%")), F.when(fin["choke"] > 0, F.concat(F.lit("choke −1 → "), nfin["choke"].cast("string"), F.lit("px")))))
        .when(critique == "interior-lost", F.when(p["strategy"] != "flood", F.lit("strategy → flood (preserves enclosed pixels)")).otherwise(F.concat(F.lit("tolerance −2 → "), _shown(n["tolerance"]), F.lit("% (already flood)"))))
        .when(critique == "edge-halo", F.concat(F.lit("choke +1 → "), nfin["choke"].cast("string"), F.lit("px, threshold +16 → "), nfin["alpha_threshold"].cast("string")))
        .when(critique == "edge-jaggy", F.concat(F.lit("feather +1 → "), _shown(n["edge_feather"]), F.lit("px")))
        .when(critique == "edge-shrunk", F.concat(F.lit("choke −1 → "), nfin["choke"].cast("string"), F.lit("px, threshold −16 → "), nfin["alpha_threshold"].cast("string")))
        .when(critique == "edge-soft", F.concat(F.lit("feather −1 → "), _shown(n["edge_feather"]), F.lit("px, solid-edges enforced")))
        .when(critique == "color-tint", F.when(~fin["despill"], F.lit("auto-despill enabled")).otherwise(F.lit("despill already on (no further action)")))
        .when(critique == "color-tint-clean", F.when(fin["despill"], F.lit("auto-despill disabled (skipping extra step)")).otherwise(F.lit("despill already off")))
    )


def apply_critiques(p: Column, ids: Column) -> Column:
    """A left fold over an array of critiques."""
    return F.aggregate(ids, p, apply_critique)


def aggregate_samples(samples: DataFrame, *keys: str) -> DataFrame:
    """samples (keys, seq, accepted params) to one consensus each: rounded means, majorities, modal colour.

    One accepted sample is returned unchanged; ties go to true, to flood, and to the colour met first.
    """
    a = samples.where("accepted is not null").select(*keys, "seq", "accepted.*")
    up = lambda c: F.floor(F.avg(c) + 0.5)
    most = lambda c: F.count_if(c) * 2 >= F.count("*")
    colours = a.groupBy(*keys, "color").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    colour = colours.groupBy(*keys).agg(F.max_by("color", F.struct("n", (-F.col("first")).alias("f"))).alias("color"))
    rest = a.groupBy(*keys).agg(
        F.count("*").alias("n_accepted"), F.when(F.count("*") == 1, F.max("tolerance")).otherwise(up("tolerance")).cast("double").alias("tolerance"),
        F.when(most(F.col("strategy") == "flood"), "flood").otherwise("global").alias("strategy"),
        F.when(F.count("*") == 1, F.max("edge_feather")).otherwise(up("edge_feather")).cast("double").alias("edge_feather"),
        most(F.col("finish.solid_edges")).alias("solid_edges"), up("finish.alpha_threshold").cast("int").alias("alpha_threshold"),
        up("finish.choke").cast("int").alias("choke"), most(F.col("finish.despill")).alias("despill"),
    )
    return rest.join(colour, list(keys)) if keys else rest.crossJoin(colour)
