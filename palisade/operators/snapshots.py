"""Live snapshot lines: parsing, entity ids, change detection, distinct states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade import constants as C
from palisade.functions import text
from palisade.operators import blocks

_BLANK_RUN = f"[{C.BLANKS}]+"


def _stripped(line: Column) -> Column:
    return F.regexp_replace(line, f"^{_BLANK_RUN}|{_BLANK_RUN}$", "")


def parse_lines(lines: DataFrame) -> DataFrame:
    """Adds ``data`` to rows with ``source`` and ``line``; unusable lines are dropped.

    Words beyond the source's columns are joined as ``extra_info``; a line with fewer words
    is no record.
    """
    words = F.split(_stripped(F.col("line")), _BLANK_RUN)
    names, width = None, None
    for source, columns in C.SNAPSHOT_COLUMNS.items():
        known = F.array(*[F.lit(c) for c in columns])
        is_it = F.col("source") == source
        names = F.when(is_it, known) if names is None else names.when(is_it, known)
        width = (F.when(is_it, len(columns)) if width is None
                 else width.when(is_it, len(columns)))
    split = lines.where(~text.is_garbage(F.col("line"))).withColumns({
        "_words": words,
        "_names": F.coalesce(names, F.array().cast("array<string>")),
        "_width": F.coalesce(width, F.lit(0)),
    }).where(F.size("_words") >= F.col("_width"))
    rest = F.array_join(F.slice("_words", F.col("_width") + 1, F.size("_words")), " ")
    fixed = F.map_from_arrays("_names", F.slice("_words", F.lit(1), F.col("_width")))
    more = F.when(F.size("_words") > F.col("_width"),
                  F.map_concat(fixed, F.create_map(F.lit("extra_info"), rest)))
    return split.withColumn("data", F.coalesce(more, fixed)).drop(
        "_words", "_names", "_width")


def headers(lines: DataFrame) -> DataFrame:
    """Snapshot header lines with their text freed of rulers and brackets."""
    return lines.where(F.col("line").contains("--- [")).withColumn(
        "header", F.regexp_replace(_stripped(F.col("line")), r"^[ \-\[\]]+|[ \-\[\]]+$", ""))


def state_entries(data: Column) -> Column:
    """The data map as sorted entries, which can be compared."""
    return F.array_sort(F.map_entries(data))


def state_text(data: Column) -> Column:
    return F.array_join(F.transform(
        state_entries(data), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")


def entity_id(source: Column, data: Column) -> Column:
    """Identity of what a snapshot row describes; an absent part prints ``None``.

    A row of an unknown source is identified by its content.
    """
    def part(name: str) -> Column:
        return F.coalesce(F.try_element_at(data, F.lit(name)), F.lit("None"))

    return (
        F.when(source == "OS", F.concat(F.lit("OS:"), part("service_name")))
        .when(source == "NETWORK",
              F.concat(F.lit("NET:"), part("local_address"), F.lit("-"), part("pid")))
        .when(source == "APP",
              F.concat(F.lit("APP:"), part("image_name"), F.lit("-"), part("pid")))
        .otherwise(F.concat(F.lit("GENERIC:"), F.md5(state_text(data))))
    )


def identified(snapshots: DataFrame) -> DataFrame:
    return snapshots.withColumn("uid", entity_id(F.col("source"), F.col("data")))


def state_changes(snapshots: DataFrame, seed: DataFrame | None = None,
                  block_rows: int = blocks.BLOCK_ROWS) -> DataFrame:
    """Keeps a row when its entity is new or its data differs from the entity's last row.

    ``seed`` (``uid``, ``data``) holds the last known data from an earlier output.
    """
    rows = identified(snapshots).withColumn("_state", state_entries(F.col("data")))
    seen = blocks.previous_value(rows, ["uid"], "seq", F.col("_state"),
                                 blocks.block_of(F.col("seq"), block_rows))
    if seed is not None:
        known = seed.select("uid", F.struct(state_entries(F.col("data")).alias("v"))
                            .alias("_seed"))
        # a seed counts for the first row of its entity only
        first = seen.where(F.col("previous").isNull()).join(known, "uid", "left").withColumn(
            "previous", F.col("_seed")).drop("_seed")
        seen = seen.where(F.col("previous").isNotNull()).unionByName(first)
    changed = F.col("previous").isNull() | ~F.col("previous.v").eqNullSafe(F.col("_state"))
    return seen.where(changed).drop("previous", "_state")


def distinct_states(snapshots: DataFrame) -> DataFrame:
    """The first row of every (entity, data) pair; partial aggregation absorbs copies."""
    rows = identified(snapshots).withColumn("_state", state_entries(F.col("data")))
    others = [c for c in rows.columns if c not in ("uid", "_state", "seq")]
    kept = rows.groupBy("uid", "_state").agg(
        F.min("seq").alias("seq"), F.min_by(F.struct(*others), "seq").alias("_row"))
    return kept.select("uid", "seq", "_row.*")


def last_states(kept: DataFrame) -> DataFrame:
    """Per entity the state that was first seen last: what a restarted filter starts from."""
    return kept.groupBy("uid").agg(F.max_by("data", "seq").alias("data"))
