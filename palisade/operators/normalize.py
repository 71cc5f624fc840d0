"""Raw rows to frames, and the enrichment that every frame gets before scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade import constants as C
from palisade.functions import text, times

FLOW_COLUMNS = {
    "Destination Port": "dst_pt",
    "Total Length of Fwd Packets": "b_out",
    "Total Length of Bwd Packets": "b_in",
    "Label": "label",
}


def _whole_number(raw: Column) -> Column:
    """Text as bigint; fractions are cut, unreadable text becomes null."""
    return F.coalesce(raw.try_cast("bigint"), raw.try_cast("double").try_cast("bigint"))


def keep_flow_columns(raw: DataFrame) -> DataFrame:
    """The flow columns that the file has, under their frame names."""
    return raw.select(*[F.col(f"`{old}`").alias(new) for old, new in FLOW_COLUMNS.items()
                        if old in raw.columns], *[c for c in ("dataset", "seq")
                                                  if c in raw.columns])


def unreadable_flows(flows: DataFrame) -> DataFrame:
    """Rows that ``normalize_flow`` leaves out: a present number that is not one."""
    bad = F.lit(False)
    for name in C.FLOW_FEATURES:
        if name in flows.columns:
            bad = bad | _whole_number(F.col(name).cast("string")).isNull()
    return flows.where(bad)


def normalize_flow(flows: DataFrame, base: Column) -> DataFrame:
    """Flow rows (``keep_flow_columns`` plus ``dataset`` and ``seq``) to frames."""
    numbers = {}
    readable = F.lit(True)
    for name in C.FLOW_FEATURES:
        if name in flows.columns:
            numbers[name] = _whole_number(F.col(name).cast("string"))
            readable = readable & numbers[name].isNotNull()
        else:
            numbers[name] = F.lit(0).cast("bigint")
    label = (F.coalesce(F.col("label").cast("string"), F.lit("nan"))
             if "label" in flows.columns else F.lit("BENIGN"))
    return flows.where(readable).select(
        times.synthetic_ts(F.col("seq"), base).alias("ts"),
        F.lit(C.UNKNOWN_IP).alias("src_ip"),
        F.lit(C.UNKNOWN_IP).alias("dst_ip"),
        F.lit(0).cast("bigint").alias("src_pt"),
        numbers["dst_pt"].alias("dst_pt"),
        F.lit("NA").alias("proto"),
        F.lit(C.FLOW_EVENT_ID).alias("evt_id"),
        F.lit(C.FLOW_TAG).alias("act"),
        numbers["b_in"].alias("b_in"),
        numbers["b_out"].alias("b_out"),
        label.alias("payload"),
        "dataset",
        "seq",
    )


def normalize_log(rows: DataFrame, act: str) -> DataFrame:
    """Structured-log rows (all text, plus ``dataset`` and ``seq``) to frames."""
    have = set(rows.columns)

    def cell(name: str, missing: str) -> Column:
        if name not in have:
            return F.lit(missing)
        return F.coalesce(F.col(name), F.lit("nan"))

    zero = F.lit(0).cast("bigint")
    return rows.select(
        times.log_ts_text(rows.columns).alias("ts"),
        F.lit(C.UNKNOWN_IP).alias("src_ip"),
        F.lit(C.UNKNOWN_IP).alias("dst_ip"),
        zero.alias("src_pt"),
        zero.alias("dst_pt"),
        F.lit("NA").alias("proto"),
        cell("EventId", "0").alias("evt_id"),
        F.lit(act).alias("act"),
        zero.alias("b_in"),
        zero.alias("b_out"),
        cell("Content", "").alias("payload"),
        "dataset",
        "seq",
    )


def normalize_auth_line(lines: DataFrame, base: Column) -> DataFrame:
    """One text line per event to the four fields such frames have."""
    trimmed = F.regexp_replace(F.col("value"), f"^[{C.BLANKS}]+|[{C.BLANKS}]+$", "")
    return lines.select(
        times.synthetic_ts(F.col("seq"), base).alias("ts"),
        F.lit(C.UNKNOWN_IP).alias("src_ip"),
        trimmed.alias("payload"),
        F.lit("AUTH_WINDOWS").alias("act"),
        "dataset",
        "seq",
    )


def with_defaults(frames: DataFrame) -> DataFrame:
    """Fills the fields a source may leave out."""
    fill = {"src_ip": F.lit(C.UNKNOWN_IP), "act": F.lit(C.FLOW_TAG), "payload": F.lit(""),
            **{name: F.lit(0).cast("bigint") for name in C.FLOW_FEATURES}}
    out = {}
    for name, default in fill.items():
        if name in frames.columns:
            out[name] = F.coalesce(F.col(name), default)
        else:
            out[name] = default
    return frames.withColumns(out)


def enrich(frames: DataFrame) -> DataFrame:
    """Drops whitelisted frames, settles the source address and the layer.

    The whitelist comes first, so it also sits below any Python step added later.
    """
    kept = frames.where(~text.is_whitelisted(F.col("payload")))
    return kept.withColumns({
        "src_ip": text.resolved_ip(F.col("payload"), F.col("src_ip")),
        "tag": text.refined_layer(F.col("payload"), F.col("act")),
    })


def route_to_models(frames: DataFrame, available: list[str] | None = None) -> DataFrame:
    """Adds ``model_tag`` and drops frames whose layer has no model.

    The registry is a fixed list of layers, so the lookup is an expression, not a join.
    """
    models = C.MODEL_TAGS if available is None else available
    served = [tag for tag, model in C.MODEL_OF_TAG.items() if model in models]
    return frames.where(F.col("tag").isin(served)).withColumn(
        "model_tag", text.model_of(F.col("tag")))
