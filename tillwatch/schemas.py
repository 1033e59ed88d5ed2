"""Explicit schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

STORE_DETAIL = T.StructType(
    [
        T.StructField("store_number", T.StringType()),
        T.StructField("location_id", T.StringType()),
        T.StructField("expected_pos", T.ArrayType(T.StringType())),
    ]
)

PUBLISH = T.StructType(
    [
        T.StructField("message_key", T.StringType()),
        T.StructField("cluster_id", T.StringType()),
        T.StructField("msg_offset", T.LongType()),
        T.StructField("published_at", T.TimestampType()),
        T.StructField("expire_at", T.TimestampType()),
        T.StructField("stores", T.ArrayType(STORE_DETAIL)),
    ]
)

RESPONSE = T.StructType(
    [
        T.StructField("message_key", T.StringType()),
        T.StructField("store_number", T.StringType()),
        T.StructField("pos_hostname", T.StringType()),
        T.StructField("delivered", T.BooleanType()),
        T.StructField("consumer_ack_timestamp", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("received_at", T.TimestampType()),
        T.StructField("seq", T.LongType()),
    ]
)

# The wire form of the two requests uses these names (fixed values).
PUBLISH_JSON = T.StructType(
    [
        T.StructField("messageKey", T.StringType()),
        T.StructField("clusterId", T.StringType()),
        T.StructField("msgOffset", T.LongType()),
        T.StructField("publishedAt", T.TimestampType()),
        T.StructField("expireAt", T.TimestampType()),
        T.StructField(
            "stores",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("storeNumber", T.StringType()),
                        T.StructField("locationId", T.StringType()),
                        T.StructField("expectedPosHosts", T.ArrayType(T.StringType())),
                    ]
                )
            ),
        ),
    ]
)

RESPONSE_JSON = T.StructType(
    [
        T.StructField("messageKey", T.StringType()),
        T.StructField("storeNumber", T.StringType()),
        T.StructField("posHostname", T.StringType()),
        T.StructField("delivered", T.BooleanType()),
        T.StructField("consumerAckTimestamp", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("receivedAt", T.TimestampType()),
        T.StructField("seq", T.LongType()),
    ]
)

POS_STATUS = T.StructType(
    [
        T.StructField("status", T.StringType()),
        T.StructField("consumerAckTimestamp", T.TimestampType()),
        T.StructField("patchReceivedAt", T.TimestampType()),
    ]
)

# One publish, one store of a publish, one machine of a store. A publish is named by its key, time and
# offset; the offset differs most often, so it comes first where rows are sorted by these.
EPISODE = ["msg_offset", "published_at", "message_key"]
STORE = [*EPISODE, "store_number"]
HOST = [*STORE, "pos_hostname"]
