"""Application state from event history (H1-H4, W9) and vocabulary checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitweave import vocab

ORDER = ["occurred_at", "created_at", "event_id"]
STATE_COLUMNS = [
    "status", "status_changed_at", "applied_at", "application_channel",
    "application_portal_name", "response_channel", "response_portal_name", "notes",
]


def _filled(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) != ""


def fold_events(events: DataFrame) -> DataFrame:
    """One row of state per application from its events, in event order.

    Every pick is a ``min_by`` / ``max_by`` over the same order, so the fold is one
    aggregation whose partial step absorbs applications with very long histories.
    """
    order = F.struct(*ORDER)
    state = F.col("event_type").isin("created", "status_change") & _filled("status")
    applied = state & (F.col("status") == "applied")
    # an event without a status counts as "not applied"
    answered = ~F.col("status").eqNullSafe("applied")
    portal = F.col("channel") == "job_portal"

    def first(value: str, condition: Column) -> Column:
        return F.min_by(value, F.when(condition, order))

    def last(value: str, condition: Column) -> Column:
        return F.max_by(value, F.when(condition, order))

    return events.groupBy("application_id").agg(
        last("status", state).alias("status"),
        F.max(F.when(state, F.col("occurred_at"))).alias("status_changed_at"),
        F.min(F.when(applied, F.col("occurred_at"))).alias("_applied"),
        F.min(F.when(state & (F.col("status") == "followed_up"), F.col("occurred_at")))
        .alias("_followed"),
        first("channel", applied & _filled("channel")).alias("application_channel"),
        first("portal_name", applied & portal & _filled("portal_name"))
        .alias("application_portal_name"),
        last("channel", answered & _filled("channel")).alias("response_channel"),
        last("portal_name", answered & portal).alias("response_portal_name"),
        last("note", _filled("note")).alias("notes"),
    )


EVENT_COLUMNS = [*ORDER, "event_type", "status", "channel", "portal_name", "note"]


def pivot_conditions() -> tuple[list[Column], list[Column]]:
    """Which events compete for being the first, and which for being the last of their application."""
    state = F.col("event_type").isin("created", "status_change") & _filled("status")
    applied = state & (F.col("status") == "applied")
    answered = ~F.col("status").eqNullSafe("applied")
    portal = F.col("channel") == "job_portal"
    firsts = [
        F.lit(True), applied, state & (F.col("status") == "followed_up"), applied & _filled("channel"),
        applied & portal & _filled("portal_name"),
    ]
    lasts = [state, answered & _filled("channel"), answered & portal, _filled("note")]
    return firsts, lasts


def pivotal_events(events: DataFrame) -> DataFrame:
    """application_id and ``pivots``, the events that any pick of the fold or the creation time rests on.

    The winner among the winners of two parts is the winner of both, so folding the pivots of old
    events together with new events gives the state of all events.
    """
    firsts, lasts = pivot_conditions()
    event = F.struct(*EVENT_COLUMNS)
    picks = [F.min(F.when(c, event)) for c in firsts] + [F.max(F.when(c, event)) for c in lasts]
    return events.groupBy("application_id").agg(
        F.array_distinct(F.array_compact(F.array(*picks))).alias("pivots")
    )


def rebuild_application_state(events: DataFrame, applications: DataFrame) -> DataFrame:
    """State of every application; without any state event it falls back to draft (H1)."""
    folded = fold_events(events)
    joined = applications.select("application_id", "created_at").join(
        folded, "application_id", "left"
    )
    known = F.col("status").isNotNull()

    def kept(value: Column, name: str) -> Column:
        return F.when(known, value).alias(name)

    return joined.select(
        "application_id",
        F.coalesce("status", F.lit("draft")).alias("status"),
        F.when(known, F.col("status_changed_at")).otherwise(F.col("created_at"))
        .alias("status_changed_at"),
        kept(F.coalesce("_applied", "_followed"), "applied_at"),
        kept(F.col("application_channel"), "application_channel"),
        kept(F.col("application_portal_name"), "application_portal_name"),
        kept(F.col("response_channel"), "response_channel"),
        kept(F.col("response_portal_name"), "response_portal_name"),
        "notes",
    )


def apply_statuses(events: DataFrame, arrival: list[str] | None = None) -> DataFrame:
    """State after applying every event with a status in arrival order (H2)."""
    order = F.struct(*(arrival or ["event_id"]))
    has_status = F.col("status").isNotNull()
    applied = F.col("status") == "applied"
    followed = F.col("status") == "followed_up"
    answers = followed | (has_status & ~applied & _filled("channel"))
    portal = F.when(F.col("channel") == "job_portal", F.col("portal_name"))

    def last(value, condition: Column) -> Column:
        return F.max_by(value, F.when(condition, order))

    return events.groupBy("application_id").agg(
        last("status", has_status).alias("status"),
        last("occurred_at", has_status).alias("status_changed_at"),
        F.min_by("occurred_at", F.when(applied | followed, order)).alias("applied_at"),
        last("channel", applied & _filled("channel")).alias("application_channel"),
        last(portal, applied).alias("application_portal_name"),
        last("channel", answers & _filled("channel")).alias("response_channel"),
        last(portal, answers).alias("response_portal_name"),
    )


def edit_events(events: DataFrame, patches: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Events after edits and deletes.  A patch replaces every editable field (H3)."""
    fields = ["status", "occurred_at", "channel", "portal_name", "note"]
    patch = patches.select(
        "event_id", F.lit(True).alias("_patched"), F.col("event_type").alias("_event_type"),
        *[F.col(c).alias(f"_{c}") for c in fields if c != "portal_name"],
        F.when(F.col("channel") == "job_portal", F.col("portal_name")).alias("_portal_name"),
    )
    edited = events.join(tombstones.select("event_id"), "event_id", "left_anti").join(
        patch, "event_id", "left"
    )
    for field in fields:
        edited = edited.withColumn(
            field, F.when(F.col("_patched"), F.col(f"_{field}")).otherwise(F.col(field))
        )
    edited = edited.withColumn("event_type", F.coalesce("_event_type", "event_type"))
    return edited.select(*events.columns)


def touched_applications(events: DataFrame, *changes: DataFrame) -> DataFrame:
    """Distinct applications whose events are named by any change table."""
    ids = changes[0].select("event_id")
    for change in changes[1:]:
        ids = ids.unionByName(change.select("event_id"))
    return events.join(ids.distinct(), "event_id", "left_semi").select("application_id").distinct()


def timeline(events: DataFrame, state: DataFrame) -> DataFrame:
    """Events newest first with their application's state, in long form (H4).

    Long form instead of one nested list: an application with a very long history stays
    spread over tasks, and the global sort is range partitioned.
    """
    return events.join(
        state.select("application_id", F.col("status").alias("current_status"), "applied_at"),
        "application_id",
    ).orderBy("application_id", F.desc("occurred_at"), F.desc("event_id"))


def vocabulary_reject(event_type: Column, status: Column, channel: Column) -> Column:
    """Reason why an event row is outside the closed vocabularies, else NULL."""
    return (
        F.when(event_type.isNull() | ~event_type.isin(*vocab.EVENT_TYPES), "event_type")
        .when(status.isNotNull() & ~status.isin(*vocab.APPLICATION_STATUSES), "status")
        .when(channel.isNotNull() & ~channel.isin(*vocab.APPLICATION_CHANNELS), "channel")
    )


def validate_events(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined with a reason)."""
    reason = vocabulary_reject(F.col("event_type"), F.col("status"), F.col("channel"))
    marked = events.withColumn("reject_reason", reason)
    return (
        marked.where(F.col("reject_reason").isNull()).drop("reject_reason"),
        marked.where(F.col("reject_reason").isNotNull()),
    )


def remap_status(rows: DataFrame, old: str, new: str) -> DataFrame:
    """Replace one status value by another."""
    return rows.withColumn(
        "status", F.when(F.col("status") == old, F.lit(new)).otherwise(F.col("status"))
    )
