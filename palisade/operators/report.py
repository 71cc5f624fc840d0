"""Summaries over the alerts table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade import constants as C
from palisade.functions import scoring


def kpis(alerts: DataFrame) -> DataFrame:
    return alerts.agg(
        F.count("*").alias("total"),
        F.countDistinct("src_ip").alias("sources"),
        F.count_if(F.col("tag").contains("AUTH")).alias("auth"),
        F.count_if(F.col("score") >= C.CRITICAL_SCORE).alias("critical"))


def per_tag(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag")


def top_sources(alerts: DataFrame, n: int = C.TOP_SOURCES) -> DataFrame:
    counted = alerts.groupBy("src_ip").agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), "src_ip").limit(n)


def of_tag(alerts: DataFrame, tag: str = "ALL") -> DataFrame:
    return alerts if tag == "ALL" else alerts.where(F.col("tag") == tag)


def tags(alerts: DataFrame) -> DataFrame:
    return alerts.select("tag").distinct()


def feed(alerts: DataFrame, tag: str = "ALL", n: int = C.FEED_ROWS) -> DataFrame:
    """The newest alerts; sort and limit become one top-n step."""
    newest = of_tag(alerts, tag).orderBy(F.desc("ts"), "seq").limit(n)
    return newest.withColumn("severity", scoring.severity(F.col("score")))


def run_totals(scanned: DataFrame, alerts: DataFrame) -> DataFrame:
    """Records read and alerts raised, as one row."""
    counts = scanned.agg(F.count("*").alias("scanned"), F.lit(0).cast("bigint").alias("raised"))
    raised = alerts.agg(F.lit(0).cast("bigint").alias("scanned"), F.count("*").alias("raised"))
    return counts.unionByName(raised).agg(
        F.sum("scanned").alias("scanned"), F.sum("raised").alias("raised"))
