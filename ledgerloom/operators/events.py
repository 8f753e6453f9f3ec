"""Events of exceptions and findings judged in their order: each is accepted into its matter's history, or rejected and passed over.

What an event finds depends on all accepted before it, so a matter's events are a fold. They
stream by in order, sorted by Spark, and a task holds the state of one matter: its status, its
active links and the keys under which events were accepted. The same judges serve a batch and a
stream (`ledgerloom.streaming.matters`); their state is plain data.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ledgerloom.operators.matters import STATE_OF_REVIEW

State = dict[str, Any]
Judge = Callable[[State, dict[str, Any]], str]

#: States of exceptions.
INVESTIGATED, DISMISSED, CONCLUDED = "UNDER_INVESTIGATION", "CLOSED_NO_FINDING", "CONCLUDED_WITH_FINDING"
#: What a judged event has more than an event.
VERDICT = StructType().add("outcome", "string").add("event_seq", "long").add("status", "string").add("n_links", "long").add("version_no_now", "long")

EXCEPTION_EVENT = ("exception_id", "arrival", "event_type", "actor_id", "engagement_id", "result_id", "to_status", "note", "title", "idempotency_key")
FINDING_EVENT = ("finding_id", "arrival", "event_type", "actor_id", "engagement_id", "version_no", "content_hash", "idempotency_key")


def _known(state: State, key: list[Any], payload: list[Any]) -> str | None:
    """REPEATED if an event was accepted under this key with this payload, CONFLICT if with another, else None."""
    accepted = state.setdefault("accepted", {}).get(repr(key))
    return None if accepted is None else "REPEATED" if accepted == repr(payload) else "CONFLICT"


def _accept(state: State, key: list[Any], payload: list[Any], events: int = 1) -> str:
    state["accepted"][repr(key)] = repr(payload)
    state["seq"] = state.get("seq", 0) + events
    return "ACCEPTED"


def judge_exception(state: State, event: dict[str, Any]) -> str:
    """Outcome of an exception's event, of which `state` takes up an accepted one.

    CREATE links the first result too and so makes two events. The same event under the same key
    of an actor changes nothing; another payload under that key is a CONFLICT. Dismissal needs a
    rationale, conclusion a concluded finding; actors belong to the engagement and so do results.
    """
    kind, actor, key = event["event_type"], event["actor_id"], event["idempotency_key"]
    links = state.setdefault("links", [])
    if kind == "STATUS" and event["to_status"] == DISMISSED and not (event["note"] or "").strip():
        return "NO_RATIONALE"
    if kind == "CREATE":
        own, payload = ["CREATE", key], [event["engagement_id"], actor, event["title"], event["result_id"]]
        if known := _known(state, own, payload):
            return known
        problem = "EXISTS" if "status" in state else "NO_RESULT" if event["result_engagement"] is None else "NOT_MEMBER" if not event["actor_is_member"] else "OTHER_ENGAGEMENT" if event["result_engagement"] != event["engagement_id"] else None
        if problem:
            return problem
        state |= {"status": INVESTIGATED, "engagement": event["engagement_id"]}
        links.append(event["result_id"])
        return _accept(state, own, payload, 2)
    if "status" not in state:
        return "NOT_FOUND"
    linking = kind in ("LINK", "UNLINK")
    own = [kind, actor, key]
    payload = [event["result_id"]] if linking else [event["to_status"]] if event["to_status"] == CONCLUDED else [event["to_status"], event["note"]]
    if known := _known(state, own, payload):
        return known
    if kind == "STATUS" and event["to_status"] not in (DISMISSED, CONCLUDED) or kind == "REOPEN" and event["to_status"] != INVESTIGATED or not linking and kind not in ("STATUS", "REOPEN"):
        return "UNKNOWN"
    if kind == "STATUS" and event["to_status"] == CONCLUDED and not event["has_concluded_finding"]:
        return "NO_CONCLUDED_FINDING"
    if linking and event["result_engagement"] is None:
        return "NO_RESULT"
    if event["engagement_id"] != state["engagement"] or linking and event["result_engagement"] != state["engagement"]:
        return "OTHER_ENGAGEMENT"
    if not event["actor_is_member"]:
        return "NOT_MEMBER"
    if kind == "LINK" and event["result_id"] not in links:
        links.append(event["result_id"])
    elif kind == "UNLINK" and event["result_id"] in links:
        links.remove(event["result_id"])
    elif not linking:
        state["status"] = event["to_status"]
    return _accept(state, own, payload)


def judge_finding(state: State, event: dict[str, Any]) -> str:
    """Outcome of a finding's event, of which `state` takes up an accepted one.

    A finding is made with its first version, where its exception has an active link. Drafts are
    revised and submitted; what is in review is approved or returned in its current version, by
    another than who prepared that. Only reviews are numbered.
    """
    kind, actor, key = event["event_type"], event["actor_id"], event["idempotency_key"]
    content, version = event["content_hash"], event["version_no"]
    exists, status = "status" in state, state.get("status")
    if kind in ("CREATE", "REVISE"):
        own, payload = [kind, key], [actor, content] if kind == "CREATE" else [content]
        if not exists and kind == "REVISE":
            return "NOT_FOUND"
        if known := _known(state, own, payload):
            return known
        problem = "EXISTS" if kind == "CREATE" and exists else "NO_LINK" if kind == "CREATE" and not event["has_active_link"] else "NOT_DRAFT" if kind == "REVISE" and status != "DRAFT" else "NOT_MEMBER" if not event["actor_is_member"] else None
        if problem:
            return problem
        state |= {"status": "DRAFT", "version": state.get("version", 0) + 1, "preparer": actor}
        return _accept(state, own, payload, 0)
    if not exists:
        return "NOT_FOUND"
    if kind not in STATE_OF_REVIEW:
        return "UNKNOWN"
    own, payload = [kind, actor, key], [] if kind == "SUBMIT" else [version]
    if known := _known(state, own, payload):
        return known
    if kind == "SUBMIT":
        problem = "NOT_DRAFT" if status != "DRAFT" else None
    else:
        problem = "NOT_IN_REVIEW" if status != "IN_REVIEW" else "NOT_CURRENT" if version != state["version"] else None
    problem = problem or (None if event["actor_is_member"] else "NOT_MEMBER") or ("OWN_WORK" if kind != "SUBMIT" and actor == state["preparer"] else None)
    if problem:
        return problem
    state["status"] = STATE_OF_REVIEW[kind]
    return _accept(state, own, payload)


def verdict(state: State, event: dict[str, Any], judge: Judge) -> dict[str, Any]:
    """The event with VERDICT: what came of it and what holds after it."""
    outcome = judge(state, event)
    return event | {"outcome": outcome, "event_seq": state.get("seq", 0) if outcome == "ACCEPTED" else None, "status": state.get("status"), "n_links": len(state.get("links", ())), "version_no_now": state.get("version")}


def with_exception_guards(events: DataFrame, members: DataFrame, results: DataFrame) -> DataFrame:
    """Adds actor_is_member and result_engagement. members: engagement_id, user_id; results: result_id, engagement_id."""
    of_result = results.select("result_id", F.col("engagement_id").alias("result_engagement")).dropDuplicates(["result_id"])
    return with_actors(events, members).join(of_result, "result_id", "left")


def with_actors(events: DataFrame, members: DataFrame) -> DataFrame:
    """Adds actor_is_member."""
    known = members.select("engagement_id", F.col("user_id").alias("actor_id"), F.lit(True).alias("is_member")).distinct()
    return events.join(known, ["engagement_id", "actor_id"], "left").withColumn("actor_is_member", F.coalesce("is_member", F.lit(False))).drop("is_member")


def judged_in_order(events: DataFrame, key: str, judge: Judge) -> DataFrame:
    """Every event with its VERDICT, those of a `key` judged by arrival; events that arrive together go by all their columns.

    A key's events are sorted, not gathered: a task streams them and keeps the state of one key.
    """
    schema = StructType(events.schema.fields + VERDICT.fields)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, state, first = None, {}, True
        for batch in batches:
            out = []
            for event in batch.to_pylist():
                if first or event[key] != own:
                    own, state, first = event[key], {}, False
                out.append(verdict(state, event, judge))
            yield pa.RecordBatch.from_pylist(out, pa.schema([*batch.schema, *to_arrow_schema(VERDICT)]))

    others = sorted(c for c in events.columns if c not in (key, "arrival"))
    return events.repartition(key).sortWithinPartitions(key, "arrival", *others).mapInArrow(stream, schema)
