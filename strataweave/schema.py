"""The property graph's vocabulary and table shapes.

Fixed values: vertex labels, their prefixes, edge labels with their ends.
"""

from __future__ import annotations

from pyspark.sql import types as T

#: label -> (id prefix, scoped)
VERTEX_LABELS = {
    "Session": ("session", True),
    "Thread": ("thread", True),
    "Claim": ("claim", True),
    "Source": ("source", True),
    "Entity": ("entity", True),
    "Chunk": ("chunk", True),
    "Artifact": ("artifact", False),
    "Agent": ("agent", False),
    "Trace": ("trace", True),
    "Exchange": ("exchange", True),
}

#: label -> (from labels, to labels, may cross scopes); an empty tuple allows any label
EDGE_LABELS = {
    "CONTAINS": (("Session",), ("Claim",), False),
    "SPAWNS": (("Session",), ("Thread",), False),
    "CONTINUES": (("Session",), ("Thread",), False),
    "RESOLVES": (("Session", "Agent"), ("Thread",), False),
    "BLOCKS": (("Thread",), ("Thread",), False),
    "SOLVED_BY": (("Claim",), ("Claim",), False),
    "TOUCHES": (("Session", "Claim", "Thread"), ("Artifact",), True),
    "DERIVED_FROM": (("Session", "Claim", "Chunk"), (), True),
    "REFERENCES": (("Exchange",), (), True),
    "CONSULTS": (("Session",), ("Exchange",), True),
    "QUERIES": (("Session",), ("Trace",), False),
    "SUPERSEDES": (("Source",), ("Source",), False),
    "ABOUT": (("Claim", "Chunk"), ("Entity",), False),
    "ANCHORS": (("Claim",), ("Chunk",), False),
    "ADJACENT_IN_TEXT": (("Chunk",), ("Chunk",), False),
    "RETURNS": (("Trace",), ("Session", "Claim", "Thread", "Artifact"), True),
}

TIERS = {0: "operator", 1: "first-party", 2: "curated third-party", 3: "wild"}
TERMINAL_STATUS = ("resolved", "abandoned")

_TEXT = "session_id tool project project_evidence cwd repo_root room forked_from summary text_digest thread_id title description status kind rationale outcome category approach citation locator content_hash uri origin feed name text identifier type repo path query ranker_config judge_config judged_against exchange_id withheld policy policy_seed question expert from_scope protocol research_protocol answer answered_from answered_by_agent_type".split()
_LONG = "byte_size message_count injected_chars wall_ms duration_ms num_turns".split()
_INT = "ordinal start end returned_count withheld_count offered_count problem_ref".split()
_DOUBLE = "propensity policy_rate cost_usd cache_hit".split()
_TIME = "timestamp written_at ts answered_at".split()
_BOOL = "external worked".split()


def _fields(names: list[str], kind: T.DataType) -> list[T.StructField]:
    return [T.StructField(n, kind) for n in names]


#: One wide row for each vertex; a label's folder holds only its own columns' values.
VERTEX = T.StructType(
    [T.StructField("vid", T.StringType(), False), T.StructField("label", T.StringType()), T.StructField("scope", T.StringType()), T.StructField("tier", T.IntegerType()), T.StructField("source", T.StringType()), T.StructField("ingested_at", T.TimestampType())]
    + _fields(_TEXT, T.StringType()) + _fields(_LONG, T.LongType()) + _fields(_INT, T.IntegerType()) + _fields(_DOUBLE, T.DoubleType()) + _fields(_TIME, T.TimestampType()) + _fields(_BOOL, T.BooleanType())
)

EDGE = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("label", "src", "dst", "src_label", "dst_label")] + [T.StructField("props", T.MapType(T.StringType(), T.StringType()))]
)

_S, _L, _D, _B, _I = "STRING", "BIGINT", "DOUBLE", "BOOLEAN", "INT"


def _ddl(**kinds: str) -> str:
    return ", ".join(f"`{n}` {k}" for n, k in kinds.items())


#: Ledgers as JSON lines. Nested tool payloads stay text, so hashes of them do not change.
LEDGERS = {
    "traces": _ddl(ts=_S, session_id=_S, scope=_S, cwd=_S, tool_name=_S, tool_input=_S, tool_response=_S, agent_id=_S, agent_type=_S),
    "guards": _ddl(ts=_S, session_id=_S, scope=_S, cwd=_S, guard=_S, guard_version=_I, verdict=_S, branch=_S, fingerprint=_S, command_hash=_S, room=_S, target=_S, dispatch_id=_S, fanout=_I, via=_S, harness=_S, sender=_S, performed=_B, refusal=_S, updated_delta=_L, undelivered="ARRAY<STRING>"),
    "conditioning": _ddl(ts=_S, session_id=_S, scope=_S, event=_S, harness=_S, agent=_S, **{"class": _S}, version=_I),
    "pins": _ddl(session_id=_S, scope=_S, agent=_S, room=_S, forked_from=_S, cwd=_S, entrypoint=_S, tmux_pane=_S, repo_root=_S, project=_S, ts=_S, event=_S),
    "ceremonies": _ddl(event=_S, room=_S, ceremony_kind=_S, occasion_index=_I, occasion_id=_S, participant_scopes="ARRAY<STRING>", deliverable_ids="ARRAY<STRING>", deliverable_id=_S, arm=_S, units="ARRAY<STRING>", arms="ARRAY<STRING>", counts="ARRAY<INT>", assignment="MAP<STRING,STRING>", assignment_seed=_S, prereg_id=_S, ts=_S, ts_start=_S, ts_end=_S, outcome=_S, resolver=_S, evidence=_S, reason=_S),
    "acknowledgements": _ddl(finding=_S, reason=_S, ts=_S),
    "closes": _ddl(event=_S, ref=_S, thread_id=_S, scope=_S, basis=_S, disposition=_S, rationale=_S, proposed_by=_S, surface=_S, approver_evidence=_S, approved_by=_S, reason=_S, ts=_S),
    "rankers": _ddl(ts=_S, fingerprint=_S, pid=_S, version=_S),
    "policy": _ddl(version=_S, rate=_D, session_id=_S, scope=_S, tool=_S, ts=_S, seed=_S, offered="ARRAY<STRING>", withheld="ARRAY<STRING>", response_sha256=_S),
    "staged": _ddl(ts=_S, session_id=_S, scope=_S, surface=_S, query=_S, response_chars=_L),
    "snapshots": _ddl(name=_S, taken_at=_S, vertices=_L, edges=_L, sha256=_S, byte_size=_L, git_ref=_S, note=_S),
    "kills": _ddl(session=_S, scope=_S, cwd=_S, project=_S, repo_root=_S, op=_S, at=_D),
}
