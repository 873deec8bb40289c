"""The document store (S-*, J-23..J-26, L-*, P-20..P-24, G-15..G-17, A-07..A-09) over event tables."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.operators.ordered import folded

ACTIONS = ("explain", "resubmit", "rerun", "return", "reject", "hold", "confirm")
# The status and assignee that each action leads to.
AFTER = {
    "explain": ("under_review", "Accounting"),
    "resubmit": ("awaiting_revision", "Source system"),
    "rerun": ("awaiting_revision", "Source system"),
    "return": ("needs_correction", "End user"),
    "reject": ("rejected", "Closed"),
    "hold": ("on_hold", "Accounting"),
    "confirm": ("confirmed", "Accounting"),
}


def ingest(events: DataFrame) -> DataFrame:
    """S-01: each delivery's outcome: accepted, duplicate (same id and content) or conflict (same id, other content). Columns: source, event_id, arrival, fingerprint."""
    w = Window.partitionBy("source", "event_id").orderBy("arrival")
    first = F.first("fingerprint").over(w)
    outcome = F.when(F.row_number().over(w) == 1, "accepted").when(F.col("fingerprint") == first, "duplicate").otherwise("conflict")
    return events.withColumn("outcome", outcome)


def monotone(events: DataFrame) -> DataFrame:
    """S-02, W-09: a revision must exceed all before it. Columns: external_id, arrival, revision."""
    before = F.max("revision").over(Window.partitionBy("external_id").orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1))
    return events.withColumn("accepted", F.coalesce(F.col("revision") > before, F.lit(True)))


def latest(events: DataFrame) -> DataFrame:
    """S-03, W-10: the current view is each document's greatest revision."""
    row = F.struct(*(c for c in events.columns if c != "external_id"))
    return events.groupBy("external_id").agg(F.max_by(row, "revision").alias("r")).select("external_id", "r.*")


def attachment_asof(revisions: DataFrame, attachments: DataFrame) -> DataFrame:
    """J-23: the last attachment whose revision isn't later. One window over both kinds of rows: no pairs of revisions are made."""
    both = revisions.select("external_id", "revision", F.lit(1).alias("is_view"), F.lit(None).cast("string").alias("sha")).unionByName(attachments.select("external_id", "revision", F.lit(0).alias("is_view"), "sha"))
    w = Window.partitionBy("external_id").orderBy("revision", "is_view").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("sha", F.last("sha", ignorenulls=True).over(w)).where("is_view = 1").select("external_id", "revision", "sha")


def page(df: DataFrame, order: list, number: int, size: int) -> DataFrame:
    """L-03, L-06."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def filtered(df: DataFrame, text: str | None = None, over: tuple[str, ...] = (), **equal: str) -> DataFrame:
    """P-21..P-23: equality filters, and a text that one of the columns contains (no wildcards)."""
    for c, v in equal.items():
        df = df.where(F.col(c) == v)
    if text:
        df = df.where(F.lower(F.concat_ws(" ", *over)).contains(text.lower()))
    return df


def default_state(status: Column, codes: Column, user_codes: tuple[str, ...]) -> Column:
    """S-07: struct(state, assignee)."""
    user = F.arrays_overlap(codes, F.array(*map(F.lit, user_codes)))
    pair = lambda s, a: F.struct(F.lit(s).alias("state"), F.lit(a).alias("assignee"))
    return F.when(status == "Posted", pair("posted", "Closed")).when(status == "Rejected", pair("rejected", "Closed")).when(status == "Confirmed", pair("confirmed", "Accounting")).when(user, pair("needs_correction", "End user")).otherwise(pair("under_review", "Accounting"))


def refused(action: Column, state: Column, assignee: Column, receiver: Column, pending: Column) -> Column:
    """P-24: the first reason against an action, or null."""
    user, accounting = assignee == "End user", assignee == "Accounting"
    return (
        F.when(state.isin("posted", "rejected"), "terminal").when(pending, "pending_request")
        .when(action.isin("explain", "resubmit") & ~user, "not_end_user").when(action.isin("rerun", "return", "reject", "hold", "confirm") & ~accounting, "not_accounting")
        .when((action == "rerun") & receiver, "has_receiver").when((action == "return") & ~receiver, "no_receiver")
        .when((action == "hold") & (state == "on_hold"), "already_on_hold").when((action == "confirm") & (state == "confirmed"), "already_confirmed")
    )


def apply_action(state: dict, action: dict, seen) -> tuple[dict, str]:
    """S-04..S-06, one step of the workflow on a document's state: version, state, assignee, pending. seen: the request ids that had an effect; it has `in` and add()."""
    kind = action["action"]
    if action["request_id"] in seen:
        return state, "duplicate"
    if kind in ("accepted", "failed"):  # an acknowledgement
        if not state["pending"]:
            return state, "not_pending"
        seen.add(action["request_id"])
        changed = {"state": "action_failed", "assignee": "Accounting"} if kind == "failed" else {}
        return state | changed | {"pending": False}, kind
    if kind == "revision":
        seen.add(action["request_id"])
        resumed = {"state": "under_review", "assignee": "Accounting"} if state["state"] == "awaiting_revision" else {}
        return state | resumed | {"pending": False if resumed else state["pending"]}, "resumed" if resumed else "recorded"
    user, accounting = state["assignee"] == "End user", state["assignee"] == "Accounting"
    allowed = (user if kind in ("explain", "resubmit") else accounting) and not (kind == "rerun" and action["receiver"]) and not (kind == "return" and not action["receiver"]) and not (kind == "hold" and state["state"] == "on_hold") and not (kind == "confirm" and state["state"] == "confirmed")
    if state["state"] in ("posted", "rejected") or state["pending"] or kind not in AFTER or not allowed:
        return state, "refused"
    if action["expected_version"] is not None and action["expected_version"] != state["version"]:
        return state, "conflict"
    seen.add(action["request_id"])
    to, who = AFTER[kind]
    return {"version": state["version"] + 1, "state": to, "assignee": who, "pending": to == "awaiting_revision"}, "pending" if to == "awaiting_revision" else "recorded"


START = {"version": 0, "state": "under_review", "assignee": "Accounting", "pending": False}
STATE_SCHEMA = "external_id long, version long, state string, assignee string, pending boolean, applied long, refused long"


EFFECTS = {"refused": (0, 1), "conflict": (0, 1), "duplicate": (0, 0), "not_pending": (0, 0)}


def stepped(state: dict, action: dict, seen) -> dict:
    """The state after an action, with what it adds to applied and refused (1 and 0 unless EFFECTS says otherwise)."""
    now, outcome = apply_action(state, action, seen)
    applied, refused = EFFECTS.get(outcome, (1, 0))
    return now | {"applied": state["applied"] + applied, "refused": state["refused"] + refused}


FRESH = START | {"applied": 0, "refused": 0}


def workflow(actions: DataFrame) -> DataFrame:
    """S-04..S-06 as a batch: each document's actions folded in order of arrival, as a stream of sorted rows; a task holds one document's state and the request ids that had an effect.

    actions: external_id, arrival, request_id, action, receiver, expected_version.
    """

    def fold(rows: Iterator[dict]) -> Iterator[dict]:
        state, seen = dict(FRESH), set()
        for a in rows:
            state = stepped(state, a, seen)
        yield state | {"external_id": a["external_id"]}

    return folded(actions, ["external_id"], ["arrival"], STATE_SCHEMA, fold)
