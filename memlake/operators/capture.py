"""Captures: what four hosts send, as one payload, and what can't be published, with the reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.operators.queue import STATES, job_id

VERSION = 1
# The keys by which each host names a thing, in the order they are looked at, and the name of an unknown session.
KEYS = {
    "codex": {"session": ("session_id", "conversation_id", "id"), "event": ("hook_event_name", "event"), "dir": ("cwd", "workspace_root"), "transcript": ("transcript_path", "transcript_file"), "unknown": "unknown_session"},
    "pi": {"session": ("session_id", "sessionId"), "event": ("event",), "dir": ("cwd", "project_dir"), "transcript": ("transcript_path", "session_file"), "unknown": "unknown_pi_session"},
    "zcode": {"session": ("session_id", "sessionId"), "event": (), "dir": ("cwd", "workspace_root"), "transcript": ("transcript_path", "transcript_file"), "unknown": "unknown_zcode_session"},
    "antigravity": {"session": ("conversationId", "session_id"), "event": (), "dir": (), "transcript": ("transcriptPath", "transcript_path"), "unknown": "unknown_agy_session"},
}
STOP_EVENTS, END_EVENTS = ("agent_settled", "AgentEnd", "Stop"), ("session_shutdown", "SessionEnd")


def _first(raw: Column, keys: tuple[str, ...]) -> Column:
    """The first of the keys whose value says something: not missing, null, empty, false or zero."""
    said = [F.nullif(F.get_json_object(raw, f"$.{k}"), F.lit("")) for k in keys]
    said = [F.when(~v.isin("false", "0", "[]", "{}"), v) for v in said]
    return F.coalesce(*said) if said else F.lit(None).cast("string")


def payloads(captures: DataFrame) -> DataFrame:
    """captures (host, raw, cwd, boundary) as payloads: job_id, host, event, session_id, project_dir, transcript_path, boundary.

    raw: the JSON that a host sent; text that is no JSON counts as an empty object.
    cwd: the folder of the caller, for captures that name none. Several workspaces
    name none. boundary: what tells states of one session apart, such as the
    transcript's size.
    """
    host = F.lower("host")
    raw = F.coalesce("raw", F.lit(""))

    def by_host(pick) -> Column:
        out = F.when(F.lit(False), F.lit(""))
        for name, keys in KEYS.items():
            out = out.when(host == name, pick(name, keys))
        return out

    def event(name: str, keys: dict) -> Column:
        if name == "pi":
            e = F.coalesce(_first(raw, keys["event"]), F.lit("agent_settled"))
            return F.when(e.isin(*STOP_EVENTS), "Stop").when(e.isin(*END_EVENTS), "SessionEnd").otherwise(e)
        return F.coalesce(_first(raw, keys["event"]), F.lit("Stop"))

    def folder(name: str, keys: dict) -> Column:
        if name != "antigravity":
            return F.coalesce(_first(raw, keys["dir"]), "cwd", F.lit(""))
        paths = F.from_json(F.get_json_object(raw, "$.workspacePaths"), "array<string>")
        return F.coalesce(F.when(F.size(paths) == 1, F.nullif(paths[0], F.lit(""))), "cwd", F.lit(""))

    session = by_host(lambda n, k: F.coalesce(_first(raw, k["session"]), F.lit(k["unknown"])))
    rows = captures.select(host.alias("host"), by_host(event).alias("event"), session.alias("session_id"), by_host(folder).alias("project_dir"), by_host(lambda n, k: _first(raw, k["transcript"])).alias("transcript_path"), F.col("boundary"))
    return rows.select(job_id(F.col("host"), F.col("session_id"), F.col("event"), F.col("boundary")).alias("job_id"), "*")


def checked(published: DataFrame) -> DataFrame:
    """published (name, payload, state: JSON texts) with reason: null where it is whole, else why it goes to quarantine."""
    payload = F.from_json("payload", "job_id string, schema_version int")
    state = F.from_json("state", "state string")
    why = (
        F.when(F.col("payload").isNull() | F.col("state").isNull(), "incomplete").when(payload["job_id"].isNull(), "corrupt_payload")
        .when(F.coalesce(payload["schema_version"], F.lit(VERSION)) != VERSION, "other_version").when(payload["job_id"] != F.col("name"), "other_job")
        .when(state["state"].isNull() | ~state["state"].isin(*STATES), "corrupt_state")
    )
    return published.withColumn("reason", why)
