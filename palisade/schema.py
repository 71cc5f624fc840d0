"""Explicit schemas; nothing in the package infers one."""

from pyspark.sql import types as T

FRAME = T.StructType([
    T.StructField("ts", T.StringType()),
    T.StructField("src_ip", T.StringType()),
    T.StructField("dst_ip", T.StringType()),
    T.StructField("src_pt", T.LongType()),
    T.StructField("dst_pt", T.LongType()),
    T.StructField("proto", T.StringType()),
    T.StructField("evt_id", T.StringType()),
    T.StructField("act", T.StringType()),
    T.StructField("b_in", T.LongType()),
    T.StructField("b_out", T.LongType()),
    T.StructField("payload", T.StringType()),
])

ALERT = T.StructType([
    T.StructField("ts", T.StringType()),
    T.StructField("src_ip", T.StringType()),
    T.StructField("tag", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("is_anomaly", T.BooleanType()),
    T.StructField("forensics", T.ArrayType(T.StringType())),
    T.StructField("payload", T.StringType()),
])

SNAPSHOT = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("data", T.MapType(T.StringType(), T.StringType())),
])
