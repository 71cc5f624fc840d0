"""Scans of raw logs, stored frames and snapshots."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade import schema
from palisade.operators import normalize, sequence


def _in_file_order(raw: DataFrame, dataset: str) -> DataFrame:
    return sequence.with_file_order(raw.withColumn("dataset", F.lit(dataset)))


def _csv(spark: SparkSession, path: str, trimmed: bool) -> DataFrame:
    """All columns as text; a quote inside a quoted cell is doubled.

    The columns are those of the first file. A file whose header has others, or the same in
    another order, ends the read with an error instead of mixing up columns.
    """
    reader = spark.read.option("header", True).option("escape", '"').option(
        "ignoreLeadingWhiteSpace", trimmed)
    names = reader.csv(path).schema
    return reader.schema(names).option("enforceSchema", False).csv(path)


def flow_csv(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """The flow columns present in the file, with ``dataset`` and ``seq``."""
    return normalize.keep_flow_columns(_in_file_order(_csv(spark, path, True), dataset))


def log_csv(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """A structured log: text columns as they are, with ``dataset`` and ``seq``."""
    return _in_file_order(_csv(spark, path, False), dataset)


def text_lines(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """Lines of plain or compressed text (bz2 can be split), with ``dataset`` and ``seq``."""
    return _in_file_order(spark.read.text(path), dataset)


#: With options the optimizer leaves the schema whole, so that a record is judged by all of its
#: fields whichever of them a query reads.
_WHOLE = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}


def _records(lines: DataFrame, fields: T.StructType) -> DataFrame:
    """The fields of the JSON records in ``value``; lines that do not parse are dropped."""
    marked = T.StructType([*fields.fields, T.StructField("_corrupt_record", T.StringType())])
    rows = lines.withColumn("_record", F.from_json("value", marked, _WHOLE))
    kept = rows.where(F.col("_record").isNotNull() & F.col("_record._corrupt_record").isNull())
    return kept.select(*[c for c in lines.columns if c != "value"],
                       *[F.col(f"_record.{f.name}") for f in fields.fields])


def frames_json(spark: SparkSession, path: str, array_documents: bool = False) -> DataFrame:
    """Stored frames. JSON lines can be split; one array per file cannot.

    Records that do not parse are dropped; for an array file that is the whole file.
    """
    lines = spark.read.option("ignoreMissingFiles", True).option("wholetext", array_documents).text(
        path).select(F.col("_metadata.file_path").alias("file"), "value")
    if array_documents:
        each = F.from_json("value", T.ArrayType(T.VariantType()), _WHOLE)
        lines = lines.select("file", F.explode(F.transform(each, lambda v: F.to_json(v))).alias("value"))
    rows = _records(lines, schema.FRAME)
    return rows.select(*[f.name for f in schema.FRAME.fields], "file")


def frames_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def snapshot_json(spark: SparkSession, path: str) -> DataFrame:
    """Snapshot records as JSON lines, ``seq`` being the line; broken lines are dropped."""
    lines = _in_file_order(spark.read.text(path), "snapshots").drop("dataset")
    return _records(lines, schema.SNAPSHOT)


def unreadable(spark: SparkSession, entries: list[tuple[str, str, str, str]]) -> DataFrame | None:
    """The flow rows that ``routed`` leaves out, for a quarantine table; None without flows."""
    out = None
    for dataset, kind, _, path in entries:
        if kind == "flow":
            rows = normalize.unreadable_flows(flow_csv(spark, path, dataset)).select(
                "dataset", "seq", F.to_json(F.struct("*")).alias("record"))
            out = rows if out is None else out.unionByName(rows)
    return out


def routed(spark: SparkSession, entries: list[tuple[str, str, str, str]],
           base: Column) -> DataFrame:
    """Frames of all ``(dataset, format, layer, path)`` entries; missing paths are skipped."""
    out = None
    for dataset, kind, act, path in entries:
        try:
            if kind == "flow":
                frames = normalize.normalize_flow(flow_csv(spark, path, dataset), base)
            elif kind == "log":
                frames = normalize.normalize_log(log_csv(spark, path, dataset), act)
            else:
                frames = normalize.normalize_auth_line(
                    text_lines(spark, path, dataset), base).withColumn("act", F.lit(act))
        except AnalysisException as problem:
            if problem.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        out = frames if out is None else out.unionByName(frames, allowMissingColumns=True)
    if out is None:
        raise ValueError("none of the configured paths exists")
    return out
