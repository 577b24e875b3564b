"""Spark schemas of the archive tables."""

from pyspark.sql import types as T

DUMP = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("sender", T.StringType()),
        T.StructField("content", T.StringType()),
    ]
)

MESSAGES = T.StructType(
    [
        T.StructField("msg_id", T.StringType(), False),
        T.StructField("chat_id", T.StringType(), False),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("from_id", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)

CHUNKS = T.StructType(
    [
        T.StructField("chunk_id", T.StringType(), False),
        T.StructField("chat_id", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("msg_id_start", T.StringType()),
        T.StructField("msg_id_end", T.StringType()),
        T.StructField("ts_from", T.TimestampNTZType()),
        T.StructField("ts_to", T.TimestampNTZType()),
        T.StructField("message_count", T.IntegerType()),
        T.StructField("metadata", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("embedding_dim", T.IntegerType()),
        T.StructField("topic_l1_id", T.LongType()),
        T.StructField("topic_l2_id", T.LongType()),
    ]
)

TOPICS_L1 = T.StructType(
    [
        T.StructField("topic_id", T.LongType(), False),
        T.StructField("title", T.StringType()),
        T.StructField("descr", T.StringType()),
        T.StructField("parent_l2_id", T.LongType()),
        T.StructField("chunk_count", T.LongType()),
        T.StructField("msg_count", T.LongType()),
        T.StructField("ts_from", T.TimestampNTZType()),
        T.StructField("ts_to", T.TimestampNTZType()),
        T.StructField("center_vec", T.ArrayType(T.DoubleType())),
    ]
)

TOPICS_L2 = T.StructType(
    [
        T.StructField("topic_id", T.LongType(), False),
        T.StructField("title", T.StringType()),
        T.StructField("descr", T.StringType()),
        T.StructField("chunk_count", T.LongType()),
        T.StructField("center_vec", T.ArrayType(T.DoubleType())),
    ]
)

INDEX = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("document", T.StringType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
        T.StructField("vector", T.ArrayType(T.FloatType())),
    ]
)

VECTOR_FILE = "id string, embedding array<double>"
