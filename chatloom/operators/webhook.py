"""Webhook envelopes `(headers MAP, body STRING, received_at TIMESTAMP)` to messages."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from chatloom.functions import bodies, fixed
from chatloom.functions.captured import snippet
from chatloom.session import settled


# --- strict path: signed chat events ----------------------------------------------


def admission_reason(headers: Column) -> Column:
    """Null when signature, id and time headers are all non-empty, else what is missing."""
    missing = [
        F.when(F.coalesce(bodies.header(headers, name), F.lit("")) == "", name)
        for name in (fixed.H_SIGNATURE, fixed.H_MESSAGE_ID, fixed.H_TIMESTAMP)
    ]
    names = F.concat_ws(",", *missing)
    return F.when(names != "", F.concat(F.lit("missing_header:"), names))


def event_route(event_type: Column) -> Column:
    """`process`, `ignore` (another type) or `unknown` (no type)."""
    return (
        F.when(event_type == fixed.CHAT_EVENT, "process")
        .when(F.coalesce(event_type, F.lit("")) != "", "ignore")
        .otherwise("unknown")
    )


PAYLOAD_SCHEMA = """
    message_id string,
    broadcaster struct<is_anonymous:boolean,user_id:bigint,username:string,is_verified:boolean,
        profile_picture:string,channel_slug:string,
        identity:struct<username_color:string,badges:array<string>>>,
    sender struct<is_anonymous:boolean,user_id:bigint,username:string,is_verified:boolean,
        profile_picture:string,channel_slug:string,
        identity:struct<username_color:string,badges:array<string>>>,
    content string, emotes array<string>, _corrupt string
"""


def chat_events(envelopes: DataFrame) -> DataFrame:
    """Add `reason` (null = accepted), `username`, `message`, `timestamp`; no row is dropped.

    A bad event never stops the job: it keeps its row, a reason and the head of its body.
    """
    payload = F.from_json("body", PAYLOAD_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    route = event_route(bodies.header(F.col("headers"), fixed.H_EVENT_TYPE))
    parsed = envelopes.withColumns(
        {"_admission": admission_reason(F.col("headers")), "_route": route, "_payload": payload}
    )
    content = F.col("_payload.content")
    reason = (
        F.when(F.col("_admission").isNotNull(), F.col("_admission"))
        .when(F.col("_route") != "process", F.concat(F.lit("event_type:"), "_route"))
        .when(F.col("_payload._corrupt").isNotNull() | F.col("_payload").isNull(), "invalid_json")
        .when(F.length(F.coalesce(content, F.lit(""))) == 0, "empty_content")
    )
    # Settled twice: the parse is read by many rules, and the outcome by the filters of the callers.
    return settled(settled(parsed).select(
        *envelopes.columns,
        reason.alias("reason"),
        F.when(reason.isNotNull(), snippet(F.col("body"))).alias("body_head"),
        bodies.header(F.col("headers"), fixed.H_MESSAGE_ID).alias("msg_key"),
        F.coalesce("_payload.sender.username", F.lit(fixed.UNKNOWN_SENDER)).alias("username"),
        content.alias("message"),
        bodies.header(F.col("headers"), fixed.H_TIMESTAMP).alias("timestamp"),
    ))


def accepted(events: DataFrame) -> DataFrame:
    return events.filter(F.col("reason").isNull()).drop("reason", "body_head")


def rejected(events: DataFrame) -> DataFrame:
    return events.filter(F.col("reason").isNotNull())


# --- tolerant path: any event, many shapes ----------------------------------------


def normalise_envelopes(envelopes: DataFrame, indicators: Iterable[str] = fixed.TEST_INDICATORS) -> DataFrame:
    """Add `body_kind`, `event_class`, `is_test`, `id`, `username`, `message`, `sentiment`, `reason`.

    The body is parsed once; every later rule reads the same two maps of members.
    """
    words = list(indicators)
    parsed = settled(envelopes.withColumn("_json", F.try_parse_json("body")))
    parsed = settled(parsed.withColumn(
        "_fields",
        F.when(F.col("_json").isNotNull(), bodies.members(F.col("_json"))).otherwise(bodies.form_members(F.col("body"))),
    ))
    parsed = settled(parsed.withColumn("_facts", bodies.value_facts(F.col("_fields"))))
    fields, facts = F.col("_fields"), F.col("_facts")
    kind = F.when(F.col("_json").isNotNull(), "json").when(fields.isNotNull(), "form").otherwise("invalid")
    rows = settled(parsed.select(
        *envelopes.columns,
        kind.alias("body_kind"),
        bodies.is_test_body(fields, facts, words).alias("is_test"),
        bodies.body_id(facts, F.col("body")).alias("id"),
        bodies.body_sender(fields, facts).alias("username"),
        bodies.body_text(facts).alias("message"),
        bodies.header(F.col("headers"), fixed.H_EVENT_TYPE).alias("event_type"),
    ))
    event_class = (
        F.when(F.col("body_kind") == "invalid", F.lit(None).cast("string"))
        .when(F.col("is_test"), "test")
        .when(F.coalesce("event_type", F.lit("")) != "", "kick")
        .otherwise("unknown")
    )
    reason = (
        F.when(F.col("body_kind") == "invalid", "invalid_body")
        .when(F.col("message").isNull() | F.col("username").isNull(), "no_message_or_sender")
    )
    return rows.withColumns(
        {
            "event_class": event_class,
            "sentiment": F.lit(fixed.PENDING_SENTIMENT),
            "reason": reason,
            "body_head": F.when(reason.isNotNull(), snippet(F.col("body"))),
        }
    )


def stored_messages(normalised: DataFrame) -> DataFrame:
    """`(id, username, message, timestamp, sentiment, is_test)` of rows with text and sender."""
    return normalised.filter(F.col("reason").isNull()).select(
        "id", "username", "message", F.col("received_at").alias("timestamp"), "sentiment", "is_test"
    )


def retrieval_filter(stored: DataFrame, test_only: bool = False, real_only: bool = False) -> DataFrame:
    """Test messages only (wins), real messages only, or all."""
    if test_only:
        return stored.filter("is_test")
    return stored.filter(~F.col("is_test")) if real_only else stored


def webhook_counters(normalised: DataFrame) -> DataFrame:
    """One row: requests, webhook, test and unknown events, time of the last request."""
    kind = F.col("event_class")
    return normalised.agg(
        F.count("*").alias("total_requests"),
        F.count_if(kind == "kick").alias("kick_events"),
        F.count_if(kind == "test").alias("test_events"),
        F.count_if(kind == "unknown").alias("unknown_events"),
        F.max("received_at").alias("last_request_time"),
    )


def stored_counts(stored: DataFrame) -> DataFrame:
    return stored.agg(
        F.count("*").alias("total"), F.count_if("is_test").alias("test"), F.count_if(~F.col("is_test")).alias("real")
    )


# --- bot messages -----------------------------------------------------------------

BOT_FIELDS = ("timestamp", "username", "message", "channel")


def bot_messages(raw: DataFrame) -> DataFrame:
    """Skip own echoes, default the author; `reason` names required fields that are null."""
    kept = raw.filter(~F.coalesce(F.col("echo"), F.lit(False))) if "echo" in raw.columns else raw
    named = kept.withColumn("username", F.coalesce("username", F.lit(fixed.UNKNOWN_SENDER)))
    missing = F.concat_ws(",", *[F.when(F.col(f).isNull(), f) for f in BOT_FIELDS])
    return named.withColumn("reason", F.when(missing != "", F.concat(F.lit("missing_field:"), missing)))
