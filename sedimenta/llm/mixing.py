"""Mixing sources to target weights along a time-varying curriculum, in DataFrame functions only.

Every source has a weight schedule over training time 0 to 1. Its integral is the source's cumulative demand; a word at
a given share of the source's stream is trained at the time where the demand reaches that share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD_SEPARATORS, all_columns, checkpoint, quoted

#: Weights of the sources in code point order, repeating.
WEIGHTS = (1.0, 2.0, 3.0)
#: Schedules as points (time, multiplier), repeating over the sources: steady, fading in, fading out.
SCHEDULES = (((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.5), (0.6, 1.0), (1.0, 0.25)))
MAX_EPOCHS = 3
#: Ranges of the order hash, for prefix sums of a source without bringing the source into one task.
BUCKETS = 4096


def n_words(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), WORD_SEPARATORS), lambda w: w != "")).cast("bigint")


def _segments(points) -> list[tuple[float, float, float, float]]:
    """(cumulative share at its start, start, density there, slope) of each piece, the whole area being 1."""
    pieces = [(a, b) for a, b in zip(points, points[1:]) if b[0] > a[0]]
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in pieces)
    out, done = [], 0.0
    for (t0, w0), (t1, w1) in pieces:
        out.append((done, t0, w0 / area, (w1 - w0) / area / (t1 - t0)))
        done += (t1 - t0) * (w0 + w1) / 2 / area
    return out


def time_at(share: Column, schedule: Column, schedules=SCHEDULES) -> Column:
    """The time at which a schedule's demand reaches a share of its whole: the integral inverted piece by piece."""
    out = None
    for k, points in enumerate(schedules):
        segments = _segments(points)
        inverse = None
        for start, t0, w, slope in segments:
            q = share - F.lit(start)
            x = q / F.lit(w) if abs(slope) < 1e-12 else (F.sqrt(F.greatest(F.lit(0.0), F.lit(w * w) + F.lit(2 * slope) * q)) - F.lit(w)) / F.lit(slope)
            here = F.lit(t0) + x
            inverse = here if inverse is None else F.when(share >= F.lit(start), here).otherwise(inverse)
        inverse = F.greatest(F.lit(0.0), F.least(F.lit(1.0), inverse))
        out = F.when(schedule == k, inverse) if out is None else out.when(schedule == k, inverse)
    return out


def targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, n_schedules: int = len(SCHEDULES)) -> DataFrame:
    """sizes(source, source_size) with target and schedule. All sizes are shared by weight; a target over max_epochs
    times its source's size stops there, and the excess is shared again among the rest until none is above."""
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    k = F.row_number().over(order) - 1
    ranked = sizes.withColumn("k", k)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod("k", F.lit(len(weights))) + 1)
    ranked = ranked.select("source", "source_size", weight.alias("w"), F.pmod("k", F.lit(n_schedules)).alias("schedule"), (F.col("source_size") * max_epochs).cast("double").alias("cap"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.encode("source", "UTF-8"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    rest = F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    levels = ranked.withColumn("level", left / rest).withColumn("free", F.col("level") * F.col("w") <= F.col("cap"))
    level = F.min(F.when(F.col("free"), F.struct((F.col("cap") / F.col("w")).alias("r"), "level"))).over(whole)
    found = levels.withColumn("found", level["level"])
    return found.select("source", "source_size", "schedule", F.when(F.col("found").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("found") * F.col("w"))).alias("target"))


def _row_hash(id_col: str, source_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(quoted(id_col)), F.col(quoted(source_col)), F.col(quoted(text_col)))


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, schedules=SCHEDULES) -> DataFrame:
    """A row for each row of docs: doc_id, h, source, size, source_size, target, schedule, taken, copies, first (words
    of the source's stream before the document) and stream (words the source gives in all).

    A source's documents stand in the order of a hash of id, source and text, and are taken round after round, whole,
    until the target is reached as nearly as whole documents allow. Null texts have size 0 and are not taken; a null
    source is a source; repeated rows stand together and are decided alike; an empty table gives an empty one."""
    h = _row_hash(id_col, source_col, text_col)
    rows = docs.select(F.col(quoted(id_col)).alias("doc_id"), F.col(quoted(source_col)).alias("source"), n_words(F.col(quoted(text_col))).alias("size"), h.alias("h"))
    rows = checkpoint(rows.withColumn("bucket", F.shiftrightunsigned("h", 64 - BUCKETS.bit_length() + 1)))
    sums = checkpoint(rows.groupBy("source", "bucket").agg(F.sum("size").alias("words")))
    goal = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, n_schedules=len(schedules))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("start"))
    starts = starts.join(goal, F.col("s").eqNullSafe(F.col("source"))).drop("source")
    alike = rows.groupBy("source", "bucket", "h", "doc_id", "size").agg(F.count("*").alias("n"))
    run = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = alike.withColumn("inside", F.coalesce(F.sum(F.col("n") * F.col("size")).over(run), F.lit(0)))
    joined = placed.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).withColumn("before", F.col("start") + F.col("inside"))
    rounds = F.when(F.col("source_size") > 0, F.least(F.lit(MAX_EPOCHS), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("int")
    more = F.col("target") - rounds * F.col("source_size")
    extra = (rounds < MAX_EPOCHS) & (F.col("size") > 0) & (F.col("before") + F.col("n") * F.col("size") / 2 <= more) & (more > 0)
    copies = F.when(F.col("size") > 0, rounds + extra.cast("int")).otherwise(0)
    chosen = checkpoint(joined.withColumn("copies", copies).select("doc_id", "h", "source", "size", "source_size", "target", "schedule", "copies", "before", "n"))
    return _settle(chosen)


def _settle(chosen: DataFrame) -> DataFrame:
    """One document of each source is taken once more or once less, where that brings the source nearer its target."""
    words = F.col("n") * F.col("size")
    gaps = chosen.groupBy(F.col("source").alias("s")).agg((F.first("target") - F.sum(F.col("copies") * words)).alias("gap"))
    with_gap = chosen.join(gaps, F.col("source").eqNullSafe(F.col("s")))
    able = F.when(F.col("gap") > 0, F.col("copies") < MAX_EPOCHS).otherwise(F.col("copies") > 0) & (F.col("size") > 0)
    miss = F.abs(words - F.abs("gap"))
    one = F.min(F.when(able & (miss < F.abs("gap")), F.struct(miss.alias("miss"), "h", "doc_id")))
    change = with_gap.groupBy("s").agg(one.alias("k"), F.first(F.signum("gap")).cast("int").alias("by")).where(F.col("k").isNotNull())
    change = change.select("s", "by", F.col("k.h").alias("kh"), F.col("k.doc_id").alias("kid"))
    out = chosen.join(change, F.col("source").eqNullSafe(F.col("s")), "left")
    hit = (F.col("h") == F.col("kh")) & F.col("doc_id").eqNullSafe(F.col("kid"))
    out = out.withColumn("copies", F.col("copies") + F.when(hit, F.col("by")).otherwise(0))
    return out.select("doc_id", "h", "source", "size", "source_size", "target", "schedule", (F.col("copies") * F.col("size")).alias("taken"), "copies", "before", "n")


def position(row_copy: Column, schedules=SCHEDULES) -> Column:
    """Training time of a document's copy, 0 to 1: where its middle stands in the source's stream."""
    words = F.col("before") + row_copy * F.col("source_size") + F.col("size") / 2
    share = F.least(F.lit(1.0), words / F.nullif(F.col("target"), F.lit(0.0)))
    return time_at(F.coalesce(share, F.lit(0.0)), F.col("schedule"), schedules)


def mix_table(docs: DataFrame, schedules=SCHEDULES, **given) -> DataFrame:
    """plan_mix as a report in training order: one row for each row of docs, position being its first copy's time."""
    plan = plan_mix(docs, schedules=schedules, **given)
    each = plan.withColumn("position", F.when(F.col("copies") > 0, position(F.lit(0), schedules))).withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n"))))
    return each.select("doc_id", "size", "source_size", "target", "taken", "copies", "position").orderBy("position", "doc_id")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, schedules=SCHEDULES) -> DataFrame:
    """The training stream: the rows of docs, each as often as it is taken, range-sorted by position; columns as in docs."""
    plan = plan_mix(docs, id_col, text_col, source_col, weights, schedules).where("copies > 0")
    plan = plan.select(F.col("doc_id").alias("__llm_id"), F.col("h").alias("__llm_h"), F.transform(F.sequence(F.lit(0), F.col("copies") - 1), lambda c: position(c, schedules)).alias("__llm_at"))
    marked = docs.withColumn("__llm_row", _row_hash(id_col, source_col, text_col))
    same = (F.col("__llm_row") == F.col("__llm_h")) & F.col(quoted(id_col)).eqNullSafe(F.col("__llm_id"))
    copies = marked.join(plan, same).withColumn("__llm_position", F.explode("__llm_at"))
    return copies.orderBy("__llm_position", "__llm_row").select(*all_columns(docs))
