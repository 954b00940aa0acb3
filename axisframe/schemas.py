"""Explicit schemas: inference would mistype an all-empty ``uncertain`` column."""

from pyspark.sql import types as T

TAG_ROW = T.StructType([
    T.StructField("image_id", T.StringType()),
    T.StructField("attributes", T.ArrayType(T.StringType())),
])
CAPTION_ROW = T.StructType([
    T.StructField("image_id", T.StringType()),
    T.StructField("caption", T.StringType()),
])
LABEL_ROW = T.StructType([
    T.StructField("schema_version", T.IntegerType()),
    T.StructField("image_id", T.StringType()),
    T.StructField("object_class", T.StringType()),
    T.StructField("object_label", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("present", T.ArrayType(T.StringType())),
    T.StructField("uncertain", T.ArrayType(T.StringType())),
    T.StructField("unknown_names", T.ArrayType(T.StringType())),
    T.StructField("model", T.StringType()),
    T.StructField("latency_seconds", T.DoubleType()),
    T.StructField("usage", T.MapType(T.StringType(), T.LongType())),
    T.StructField("attempts", T.IntegerType()),
    T.StructField("sampling", T.StructType([
        T.StructField("temperature", T.DoubleType()),
        T.StructField("top_p", T.DoubleType()),
        T.StructField("repeat_penalty", T.DoubleType()),
        T.StructField("retry_repeat_penalty_step", T.DoubleType()),
    ])),
    T.StructField("errors", T.ArrayType(T.StringType())),
    T.StructField("created_at", T.TimestampType()),
])
DICTIONARY_ENTRY = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("members", T.ArrayType(T.StringType())),
    T.StructField("prevalence", T.DoubleType()),
    T.StructField("image_prevalence", T.DoubleType()),
    T.StructField("mentions", T.LongType()),
    T.StructField("class_support", T.LongType()),
])
SPLIT_MANIFEST = T.StructType([
    T.StructField("unit", T.StringType()),
    T.StructField("classes", T.MapType(T.StringType(), T.StringType())),
])
EDGE = T.StructType([
    T.StructField("edge_id", T.StringType()),
    T.StructField("left", T.StringType()),
    T.StructField("right", T.StringType()),
    T.StructField("text_cosine", T.DoubleType()),
])
DECISION = T.StructType([
    T.StructField("edge_id", T.StringType()),
    T.StructField("equivalent", T.BooleanType()),
])

SPLITS = ("train", "dev", "test")
