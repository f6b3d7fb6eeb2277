"""Explicit schemas of the tables the library reads and writes."""

from pyspark.sql import types as T

PARAM_VALUE = T.StructType(
    [
        T.StructField("string_value", T.StringType()),
        T.StructField("int_value", T.LongType()),
    ]
)

EVENT_PARAMS = T.ArrayType(
    T.StructType(
        [
            T.StructField("key", T.StringType()),
            T.StructField("value", PARAM_VALUE),
        ]
    )
)

# One row per analytics hit. `event_date` is the partition column of the table;
# `event_timestamp` is in microseconds and is only compared and sorted.
# `event_id` breaks ties between hits of equal time.
HITS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("event_timestamp", T.LongType()),
        T.StructField("user_pseudo_id", T.StringType()),
        T.StructField("event_name", T.StringType()),
        T.StructField("platform", T.StringType()),
        T.StructField("stream_id", T.StringType()),
        T.StructField("device", T.StructType([T.StructField("category", T.StringType())])),
        T.StructField("event_params", EVENT_PARAMS),
        T.StructField("event_date", T.DateType()),
    ]
)

JOURNEYS = T.StructType(
    [
        T.StructField("journey", T.StringType()),
        T.StructField("conversion_flg", T.BooleanType()),
        T.StructField("counts", T.LongType()),
    ]
)

# The category file carries two more columns (a blank one and generated text) that nothing reads.
CATEGORY_FILE = T.StructType(
    [
        T.StructField("item_category", T.StringType()),
        T.StructField("sessions", T.LongType()),
        T.StructField("content_group", T.StringType()),
        T.StructField("blank", T.StringType()),
        T.StructField("generated", T.StringType()),
    ]
)

RULES = T.StructType(
    [
        T.StructField("priority", T.IntegerType()),
        T.StructField("field", T.StringType()),
        T.StructField("match", T.StringType()),
        T.StructField("pattern", T.StringType()),
        T.StructField("event_name", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("enabled", T.BooleanType()),
    ]
)
