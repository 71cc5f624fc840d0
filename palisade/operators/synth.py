"""Benign baseline lines and injected attacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade import constants as C
from palisade.functions import text


def _draw(layer: str, slot: str, round_id: Column, seed: int) -> Column:
    """A non-negative number from a digest of seed, layer, slot and round."""
    digest = F.md5(F.concat(F.lit(f"{seed}:{layer}:{slot}:"), round_id.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def slot_value(layer: str, slot: str, round_id: Column, seed: int) -> Column:
    _, _, ranges, choices = C.BASELINES[layer]
    draw = _draw(layer, slot, round_id, seed)
    if slot in ranges:
        low, high = ranges[slot]
        number = F.lit(low) + draw % (high - low + 1)
        if slot in C.HEX_SLOTS.get(layer, ()):
            return F.concat(F.lit("0x"), F.lower(F.hex(number)))
        return number.cast("string")
    options = [str(c) for c in choices[slot]]
    return F.get(F.array(*[F.lit(c) for c in options]), (draw % len(options)).cast("int"))


def baseline_lines(spark: SparkSession, layer: str, seed: int = 42) -> DataFrame:
    """``round``, ``template`` and ``payload`` of a layer's benign lines."""
    rounds, templates, ranges, choices = C.BASELINES[layer]
    lines = []
    for i, template in enumerate(templates):
        line = F.lit(template)
        for slot in [*ranges, *choices]:
            if "{" + slot + "}" in template:
                line = F.replace(line, F.lit("{" + slot + "}"),
                                 slot_value(layer, slot, F.col("round"), seed))
        lines.append(F.struct(F.lit(i).alias("template"), line.alias("payload")))
    return (
        spark.range(rounds).withColumnRenamed("id", "round")
        .select("round", F.inline(F.array(*lines)))
    )


def augmented(frames: DataFrame, layer: str, seed: int = 42) -> DataFrame:
    """Training lines of a layer: its own payloads and the benign lines.

    Known attack lines leave the SSH baseline first; the Windows sign-on layer has no benign
    lines of its own.
    """
    own = frames.select(F.coalesce(F.col("payload").cast("string"), F.lit("")).alias("payload"))
    if layer == "AUTH_LINUX":
        own = own.where(~text.is_ssh_attack(F.col("payload")))
    if layer not in C.BASELINES:
        return own
    return own.unionByName(
        baseline_lines(frames.sparkSession, layer, seed).select("payload"))


def injected_attacks(spark: SparkSession, datasets: list[str], start: int) -> DataFrame:
    """Attack frames for the named datasets; the first matching name part decides."""
    rows = []
    for name in datasets:
        for part, ip, act, payload in C.INJECTED_ATTACKS:
            if part in name:
                rows.append((name, C.INJECTED_TS, ip, payload, act))
                break
    templates = spark.createDataFrame(
        rows, "dataset string, ts string, src_ip string, payload string, act string")
    numbers = F.sequence(F.lit(start).cast("bigint"),
                         F.lit(start + C.INJECTED_PER_DATASET - 1).cast("bigint"))
    return templates.withColumn("seq", F.explode(numbers))


def inject(frames: DataFrame, datasets: list[str], start: int) -> DataFrame:
    """Frames plus the attacks, numbered from ``start``."""
    return frames.unionByName(injected_attacks(frames.sparkSession, datasets, start),
                              allowMissingColumns=True)
