"""Correlation of a frame with the earlier suspicious frames of its source.

A frame earns the bonus when an earlier suspicious frame of the same source address sits on
another layer, or when more than five sit on the same layer. History has no time limit by
default; ``with_recent_bonus`` is the time-limited form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palisade import constants as C
from palisade.operators import blocks
from palisade.session import materialize

NEEDED_HITS = C.REPEAT_LIMIT + 1


def source_marks(frames: DataFrame) -> DataFrame:
    """One row per source address with everything correlation needs of its history.

    ``first_tag``/``first_seq``/``second_seq``: the two layers suspected first;
    ``sixth``: per layer, the position of the sixth suspicious frame.
    ``row_number() <= 6`` becomes a group limit below the shuffle, so each task sends at
    most six rows per (source, layer), however hot the source is.
    """
    earliest = Window.partitionBy("src_ip", "tag").orderBy("seq")
    hits = (
        frames.where((F.col("base") > 0) & (F.col("src_ip") != C.UNKNOWN_IP))
        .select("src_ip", "tag", "seq")
        .withColumn("nth", F.row_number().over(earliest))
        .where(F.col("nth") <= NEEDED_HITS)
    )
    layers = hits.groupBy("src_ip", "tag").agg(
        F.min("seq").alias("first"),
        F.max(F.when(F.col("nth") == NEEDED_HITS, F.col("seq"))).alias("sixth"))
    # layers are a fixed short list, so the lists below are short as well
    marks = layers.groupBy("src_ip").agg(
        F.sort_array(F.collect_list(F.struct("first", "tag"))).alias("firsts"),
        F.map_from_entries(F.collect_list(F.struct("tag", "sixth"))).alias("sixth"))
    return marks.select(
        F.col("src_ip").alias("mark_ip"),
        F.col("firsts")[0]["tag"].alias("first_tag"),
        F.col("firsts")[0]["first"].alias("first_seq"),
        F.get("firsts", F.lit(1))["first"].alias("second_seq"),
        "sixth",
    )


def cross_layer_hit() -> Column:
    other = F.when(F.col("first_tag") != F.col("tag"), F.col("first_seq")).otherwise(
        F.col("second_seq"))
    return F.coalesce(other < F.col("seq"), F.lit(False))


def repeat_hit() -> Column:
    own = F.try_element_at("sixth", F.col("tag"))
    return F.coalesce(own < F.col("seq"), F.lit(False))


def with_marks(frames: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """Adds ``cross_layer`` and ``repeated`` to frames with ``src_ip, tag, seq, base``.

    Frames without a usable address get a key that matches nothing and is spread over many
    values, so they do not meet in one task. A hot address keeps its key: the mark side
    holds one row for it, and the skew split of adaptive execution cuts the frame side. That
    split wants a shuffle right below each side; the prefixed key gives the marks their own,
    of one row per source, where they would else be joined as they leave the aggregation.
    """
    marks = source_marks(frames if history is None else history).withColumn(
        "mark_ip", F.concat(F.lit("="), "mark_ip"))
    spread = F.concat(F.lit("?"), F.col("seq").cast("string"))
    usable = F.col("src_ip").isNotNull() & (F.col("src_ip") != C.UNKNOWN_IP)
    named = F.concat(F.lit("="), "src_ip")
    keyed = frames.withColumn("_key", F.when(usable, named).otherwise(spread))
    joined = keyed.join(marks, keyed["_key"] == marks["mark_ip"], "left")
    return joined.withColumns(
        {"cross_layer": cross_layer_hit(), "repeated": repeat_hit()}
    ).drop("_key", "mark_ip", "first_tag", "first_seq", "second_seq", "sixth")


def bonus_of(hit: Column) -> Column:
    return F.when(hit, F.lit(C.CORRELATION_BONUS)).otherwise(F.lit(0.0))


def with_bonus(frames: DataFrame, history: DataFrame | None = None) -> DataFrame:
    hit = F.col("cross_layer") | F.col("repeated")
    return with_marks(frames, history).withColumn("bonus", bonus_of(hit)).drop(
        "cross_layer", "repeated")


def with_window_bonus(frames: DataFrame) -> DataFrame:
    """The same bonus as running counts of suspicious frames, per source and per layer.

    Windows run inside (source, range of rows); what earlier ranges of a source hold is added from
    one row per source, range and layer, so a hot source is spread over the ranges it fills. Frames
    of an unknown address have no history and get a key of their own.
    """
    unknown = F.coalesce(F.col("src_ip") == C.UNKNOWN_IP, F.lit(False))
    spread = F.concat(F.lit("?"), F.col("seq").cast("string"))
    frames = frames.withColumns({
        "_who": F.coalesce(F.when(unknown, spread).otherwise(
            F.concat(F.lit("="), F.col("src_ip"))), F.lit("")),
        "_layer": F.coalesce(F.concat(F.lit("="), F.col("tag")), F.lit("")),
        "_hit": (F.col("base") > 0).cast("long")})
    dealt = blocks.in_ranges(frames, [F.col("_who"), F.col("seq")], "frames")

    def counted(*keys: str) -> DataFrame:
        per = dealt.groupBy("_who", "_range", *keys).agg(F.sum("_hit").alias("_n"))
        earlier = Window.partitionBy("_who", *keys).orderBy("_range").rowsBetween(
            Window.unboundedPreceding, -1)
        return per.select("_who", "_range", *keys, F.coalesce(
            F.sum("_n").over(earlier), F.lit(0)).alias("_same0" if keys else "_all0"))

    def inside(*keys: str) -> Column:
        w = Window.partitionBy("_who", "_range", *keys).orderBy("seq").rowsBetween(
            Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("_hit").over(w), F.lit(0))

    before = counted("_layer").join(counted(), ["_who", "_range"])
    sums = dealt.withColumns({"_all": inside(), "_same": inside("_layer")}).join(
        before, ["_who", "_range", "_layer"])
    every, same = F.col("_all") + F.col("_all0"), F.col("_same") + F.col("_same0")
    hit = ~unknown & ((every > same) | (same > C.REPEAT_LIMIT))
    return sums.withColumn("bonus", bonus_of(hit)).select(
        *[c for c in frames.columns if c not in ("_who", "_layer", "_hit")], "bonus")


def _carried(dealt: DataFrame, at: str) -> DataFrame:
    """The last six hits per layer before each range of a source that began in an earlier one.

    ``dealt`` has ``_key, _range, _hit``. Hits of a (source, layer) are numbered through; a range
    asks for the six numbers before its first, and each of those is among the last six of the range
    it lies in. At most one source goes on into a range, so what is asked for is a few rows per
    range, however many rows or ranges a source has.
    """
    hits = dealt.where("_hit").select("_key", "_range", "tag", at, "seq")
    by_key = Window.partitionBy("_key").orderBy("_range")
    present = dealt.select("_key", "_range").distinct().withColumn(
        "_goes_on", F.lag("_range").over(by_key).isNotNull())
    present = materialize(present.withColumn("_long", F.max("_goes_on").over(
        Window.partitionBy("_key"))).where("_long").select("_key", "_range"), "present")
    keys = present.select("_key").distinct()
    hits = hits.join(keys, "_key", "left_semi")
    counts = materialize(hits.groupBy("_key", "_range", "tag").agg(F.count("*").alias("_n")), "counts")
    layers = counts.select("_key", "tag").distinct()
    earlier = Window.partitionBy("_key", "tag").orderBy("_range").rowsBetween(
        Window.unboundedPreceding, -1)
    grid = present.join(layers, "_key").join(counts, ["_key", "_range", "tag"], "left").select(
        "_key", "_range", "tag", F.coalesce("_n", F.lit(0)).alias("_n")).withColumn(
        "_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    grid = materialize(grid, "grid")
    latest = Window.partitionBy("_key", "_range", "tag").orderBy(F.desc(at), F.desc("seq"))
    tails = hits.withColumn("_nth", F.row_number().over(latest)).where(
        F.col("_nth") <= NEEDED_HITS).join(grid, ["_key", "_range", "tag"]).select(
        "_key", "tag", (F.col("_before") + F.col("_n") - F.col("_nth") + 1).alias("_number"), at, "seq")
    asked = grid.where(F.col("_before") > 0).select("_key", "_range", "tag", F.explode(F.sequence(
        F.greatest(F.col("_before") - (NEEDED_HITS - 1), F.lit(1)), F.col("_before"))).alias("_number"))
    return asked.join(tails, ["_key", "tag", "_number"]).drop("_number")


def with_recent_bonus(frames: DataFrame, at: str = "at",
                      span: int = C.CORRELATION_SECONDS) -> DataFrame:
    """The bonus over the last ``span`` units of the whole-number time column ``at``.

    A segmented scan: frames in order of (source, time) are cut into ranges of like size, windows
    run forward inside a range, and a source's last six hits per layer are carried into each of its
    later ranges. A source with most of the rows, even within one time unit, is spread over as many
    tasks as it fills.
    """
    usable = F.col("src_ip").isNotNull() & (F.col("src_ip") != C.UNKNOWN_IP)
    spread = F.concat(F.lit("?"), F.col("seq").cast("string"))
    base = frames.withColumns({
        "_key": F.when(usable, F.concat(F.lit("="), F.col("src_ip"))).otherwise(spread),
        "_hit": F.coalesce((F.col("base") > 0) & usable, F.lit(False))})
    order = [F.col(at), F.col("seq")]
    dealt = blocks.in_ranges(base, [F.col("_key"), *order], "frames")
    copies = _carried(dealt, at).withColumns({"_copy": F.lit(True), "_hit": F.lit(True)})
    rows = dealt.withColumn("_copy", F.lit(False)).unionByName(copies, allowMissingColumns=True)

    source = Window.partitionBy("_key", "_range").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, -1)
    layer = Window.partitionBy("_key", "_range", "tag").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, -1)
    hits_of_layer = Window.partitionBy("_key", "_range", "tag", "_hit").orderBy(*order)

    seen = rows.withColumns({
        "_last": F.last(F.when(F.col("_hit"), F.struct(F.col(at).alias("at"), "tag")),
                        ignorenulls=True).over(source),
        "_fifth": F.lag(at, C.REPEAT_LIMIT).over(hits_of_layer),
    })
    # time of the last hit on another layer than the hit itself
    switch = F.when(F.col("_hit") & (F.col("_last.tag") != F.col("tag")), F.col("_last.at"))
    held = seen.withColumn("_switch", switch).withColumns({
        "_before": F.last("_switch", ignorenulls=True).over(source),
        "_sixth": F.last(F.when(F.col("_hit"), F.struct(F.col("_fifth").alias("at"))),
                         ignorenulls=True).over(layer),
    })
    other = F.when(F.col("_last.tag") != F.col("tag"), F.col("_last.at")).otherwise(
        F.col("_before"))
    since = F.col(at) - F.lit(span)
    hit = F.coalesce(other >= since, F.lit(False)) | F.coalesce(
        F.col("_sixth.at") >= since, F.lit(False))
    return (
        held.withColumn("bonus", bonus_of(hit)).where(~F.col("_copy"))
        .select(*frames.columns, "bonus")
    )
