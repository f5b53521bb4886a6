"""Deterministic identities of vertices, claims, chunks and traces."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import normal_description, slug

GLOBAL_LABELS = ("Artifact", "Agent")


def vertex_id(scope: Column, prefix: str, local: Column) -> Column:
    """``scope:<scope>:<prefix>:<local>``, or ``<prefix>:<local>`` where the scope is null."""
    return F.when(scope.isNull(), F.concat_ws(":", F.lit(prefix), local)).otherwise(F.concat_ws(":", F.lit("scope"), scope, F.lit(prefix), local))


def scope_of(vid: Column) -> Column:
    return F.when(vid.startswith("scope:"), F.split(vid, ":", 3)[1])


def crosses_scope(src: Column, dst: Column) -> Column:
    """Both ends are scoped and their scopes differ; globals never cross."""
    a, b = scope_of(src), scope_of(dst)
    return F.coalesce(a.isNotNull() & b.isNotNull() & (a != b), F.lit(False))


@F.pandas_udf(StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """JSON with sorted keys and tight separators, ASCII-escaped; null for what is no JSON."""

    def one(x: str | None) -> str | None:
        try:
            return None if x is None else json.dumps(json.loads(x), sort_keys=True, separators=(",", ":"))
        except ValueError:
            return None

    return text.map(one)


@F.pandas_udf(StringType())
def _claim_hash(kind: pd.Series, description: pd.Series) -> pd.Series:
    form = (json.dumps({"description": d, "kind": k}, sort_keys=True, separators=(",", ":")) for k, d in zip(kind, description, strict=True))
    return pd.Series([hashlib.sha256(x.encode()).hexdigest()[:16] for x in form])


def claim_id(kind: Column, description: Column) -> Column:
    """First 16 hex digits of SHA-256 over the canonical JSON of kind and normal description."""
    return _claim_hash(kind, normal_description(description))


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def chunk_id(source_hash: Column, ordinal: Column) -> Column:
    return F.format_string("%s-%04d", source_hash, ordinal)


def entity_id(name: Column) -> Column:
    return slug(name)


def _json_string(x: Column) -> Column:
    whole = F.to_json(F.struct(x.alias("v")))
    return F.substr(whole, F.lit(6), F.length(whole) - 6)


def trace_id(session: Column, ts: Column, tool: Column, tool_input: Column) -> Column:
    """Sixteen hex digits of SHA-256 over the canonical JSON of the call."""
    parts = [F.lit('{"input":'), canonical_json(tool_input), F.lit(',"session_id":'), _json_string(session), F.lit(',"tool":'), _json_string(tool), F.lit(',"ts":'), _json_string(ts), F.lit("}")]
    return F.substring(F.sha2(F.concat(*parts), 256), 1, 16)


def occasion_id(room: Column, kind: Column, index: Column) -> Column:
    return F.concat_ws(":", room, kind, index.cast("string"))
