"""Mixing sources to target weights: whole copies plus Pareto order sampling of the rest.

Sizes are words. A source's target is its weight's share of all words, held to ``max_repeat`` times its own
words, with the excess shared again by weight. A source whose target is e times its words takes floor(e) certain copies of every
document; the rest of the target is a sample with unequal probabilities: a document's inclusion odds p / (1 - p) are the source's,
rest / (words - rest), times its size over the source's mean size, so long documents are likelier, and documents are taken in Pareto order,
smallest (U / (1 - U)) / (p / (1 - p)) first. The sample's number of documents is the one whose words come nearest to the rest. U is a hash
of seed, doc_id and text, so reruns agree and the choice does not depend on partitioning.

No source is ever sorted as a whole. The rank key in (0, 1) is cut into ``BINS`` bins; sums by bin show
which bin the target falls in, that bin is cut again, ``LEVELS`` times, and only the distinct documents of the last bin,
a two-millionth of a source, are ordered. Rows equal in doc_id, size and U count as one there; if the target
falls among them, counts by partition and row numbers say which of them are taken. Sources without a rest have no last bin.

Defined cases: a null text has size 0 and is never drawn; a null source is a source of its own, last in order; repeated rows
are taken one by one, any of them first; a source without words has target 0 and nothing is taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, settled, small_side, text_or_empty

#: Weights by source in code point order, repeating.
WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
BINS, LEVELS = 128, 3


def source_targets(sized: DataFrame, weights=WEIGHTS, max_repeat=MAX_REPEAT) -> DataFrame:
    """key, source_size, target, whole, rest, odds: one row for each source. odds is a document's for each of its words.

    Sources are ordered by max_repeat * size / weight; those below the water level are held to their cap. The
    window runs over one row a source, after aggregation.
    """
    by = sized.groupBy("key").agg(F.sum("size").alias("source_size"), F.count(F.when(F.col("size") > 0, 1)).alias("n"))
    ranked = by.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(W.orderBy("key")) - 1) % len(weights) + 1).cast("long"))
    every = W.partitionBy()
    before = W.orderBy(F.col("source_size") / F.col("w"), "key").rowsBetween(W.unboundedPreceding, -1)
    level = (
        ranked.withColumn("total", F.sum("source_size").over(every)).withColumn("all_w", F.sum("w").over(every))
        .withColumn("left_words", F.col("total") - max_repeat * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("left_w", F.col("all_w") - F.coalesce(F.sum("w").over(before), F.lit(0)))
        # the first source in this order that its share does not overfill sets the level
        .withColumn("fits", F.col("w") * F.col("left_words") <= max_repeat * F.col("source_size") * F.col("left_w"))
        .withColumn("at", F.min(F.when(F.col("fits"), F.struct(F.col("source_size") / F.col("w"), "key", "left_words", "left_w"))).over(every))
    )
    below = F.col("at").isNull() | (F.struct(F.col("source_size") / F.col("w"), "key") < F.struct(F.col("at.col1"), F.col("at.key")))
    target = F.when(below, (max_repeat * F.col("source_size")).cast("double")).otherwise((F.col("w") * F.col("at.left_words")).cast("double") / F.col("at.left_w"))
    e = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return (
        level.withColumn("target", target)
        .withColumn("whole", F.least(F.floor(e + 1e-9), F.lit(max_repeat)).cast("long"))
        .withColumn("rest", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0)))
        .withColumn("odds", F.col("rest") / F.greatest(F.col("source_size") - F.col("rest"), F.lit(1e-9)) * F.col("n") / F.greatest(F.col("source_size"), F.lit(1)))
        .select("key", "source_size", "target", "whole", "rest", "odds")
    )


def _cut_rows(tied: DataFrame) -> DataFrame:
    """key, last: the row number up to which rows are taken, k of them; tied has key, row and k, the same for all rows of a key.

    Counts by the partition that a row was written from find the partition of the k-th row; only its rows are ordered.
    """
    part = F.shiftright("row", 33)
    counts = tied.groupBy("key", "k", part.alias("part")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("key").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    at = counts.withColumn("before", before).where((F.col("before") < F.col("k")) & (F.col("before") + F.col("n") >= F.col("k")))
    inside = tied.drop("k").join(F.broadcast(at), "key").where(part == F.col("part"))  # one row a source
    nth = F.row_number().over(W.partitionBy("key").orderBy("row"))
    return inside.withColumn("nth", nth).where(F.col("nth") == F.col("k") - F.col("before")).select("key", F.col("row").alias("last"))


def taken_words(docs: DataFrame, *, seed="mix", weights=WEIGHTS, max_repeat=MAX_REPEAT, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken, and the columns ``keep`` of ``docs``."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text_or_empty())
    u = (F.conv(F.substring(F.md5(named.cast("binary")), 1, 12), 16, 10).cast("double") + 0.5) / float(16**12)
    keep = tuple(c for c in keep if c not in ("doc_id", "source"))
    sized = settled(
        docs.select(
            "doc_id", "source", F.when(F.col("source").isNull(), "1").otherwise(F.concat(F.lit("0"), F.col("source"))).alias("key"),
            F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long").alias("size"), u.alias("u"), F.monotonically_increasing_id().alias("row"), *keep,
        ),
        "op10-sized",
    )
    plan = settled(source_targets(sized, weights, max_repeat), "op10-plan")
    # state: the bin, as a prefix of bin numbers, in which a source's rest runs out, and the words before it
    state = plan.where("rest > 0").select("key", "odds", "rest", F.lit(0).cast("long").alias("bin"), F.lit(0).cast("long").alias("before"))
    q = (F.col("u") / (1 - F.col("u"))) / F.greatest(F.col("odds") * F.col("size"), F.lit(1e-300))
    at = q / (1 + q)
    narrow = sized.where("size > 0").select("doc_id", "key", "size", "u", "row")

    def cell(level: int):
        return F.least(F.floor(at * float(BINS**level)), F.lit(BINS**level - 1)).cast("long")

    for level in range(1, LEVELS + 1):
        inside = narrow.join(small_side(state), "key").where(F.floor(cell(level) / BINS) == F.col("bin"))
        bins = inside.groupBy("key", cell(level).alias("b")).agg(F.sum("size").alias("words"))
        run = bins.withColumn("upto", F.sum("words").over(W.partitionBy("key").orderBy("b")))
        # the first bin whose end passes the rest
        found = run.join(state.select("key", "rest", "before"), "key").where(F.col("before") + F.col("upto") > F.col("rest"))
        first = found.groupBy("key").agg(F.min(F.struct("b", F.col("before") + F.col("upto") - F.col("words"))).alias("s"))
        state = settled(
            state.join(first.select("key", F.col("s.b").alias("b"), F.col("s.col2").alias("start")), "key", "left").select(
                "key", "odds", "rest", F.coalesce("b", F.lit(BINS**level)).cast("long").alias("bin"), F.coalesce("start", "before").cast("long").alias("before")
            ),
            f"op10-level{level}",
        )
    inside = narrow.join(small_side(state), "key").withColumn("q", q).where(cell(LEVELS) == F.col("bin"))
    edge = inside.groupBy("key", "q", "doc_id", "size").agg(F.count("*").alias("n"), F.first("rest").alias("rest"), F.first("before").alias("before"))
    words = F.col("n") * F.col("size")
    upto = F.sum(words).over(W.partitionBy("key").orderBy("q", F.asc_nulls_last("doc_id"), "size").rowsBetween(W.unboundedPreceding, -1))
    edge = edge.withColumn("start", F.col("before") + F.coalesce(upto, F.lit(0)) + F.col("size") / 2)
    fits = F.least(F.floor((F.col("rest") - F.col("start")) / F.col("size")) + 1, F.col("n"))
    edge = settled(edge.select("key", "q", "doc_id", "size", "n", F.when(F.col("start") <= F.col("rest"), fits).otherwise(0).cast("long").alias("k")), "op10-edge")
    tied = edge.where("0 < k and k < n")  # at most one group a source
    on = (F.col("key") == F.col("key_")) & (F.col("q") == F.col("q_")) & F.col("doc_id").eqNullSafe(F.col("doc_id_")) & (F.col("size") == F.col("size_"))
    named_edge = edge.join(_cut_rows(_rows_of(inside, tied, on)), "key", "left").select(
        *[F.col(c).alias(f"{c}_") for c in ("key", "q", "doc_id", "size")],
        F.when(F.col("k") == F.col("n"), F.lit((1 << 63) - 1)).when(F.col("k") == 0, F.lit(-1)).otherwise(F.col("last")).alias("last"),
    )
    goal = plan.select("key", "source_size", "target", "whole").join(state, "key", "left")
    rows = sized.join(small_side(goal), "key").withColumn("q", q).withColumn("cell", F.when(F.col("size") > 0, cell(LEVELS)))
    rows = rows.join(small_side(settled(named_edge, "op10-last")), on & (F.col("cell") == F.col("bin")), "left")
    drawn = F.when(F.col("rest").isNull() | (F.col("size") == 0), 0).when(F.col("cell") == F.col("bin"), (F.col("row") <= F.col("last")).cast("int")).otherwise((F.col("cell") < F.col("bin")).cast("int"))
    copies = F.least(F.col("whole") + drawn, F.lit(max_repeat))
    return rows.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *keep)


def _rows_of(inside: DataFrame, tied: DataFrame, on) -> DataFrame:
    """key, row, k of the rows of the groups ``tied``."""
    few = tied.select(*[F.col(c).alias(f"{c}_") for c in ("key", "q", "doc_id", "size")], "k")
    return inside.join(small_side(few), on).select("key", "row", "k")


def mixed(docs: DataFrame, *, seed="mix", weights=WEIGHTS, max_repeat=MAX_REPEAT) -> DataFrame:
    """The columns of ``docs``, each row as often as the mix takes it."""
    held = docs.select("doc_id", "source", "text", F.struct("*").alias("__row"))
    taken = taken_words(held, seed=seed, weights=weights, max_repeat=max_repeat, keep=("__row",))
    return taken.where("copies > 0").select("__row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("__row.*")
