"""Audit rows from a web request log; works on batches and streams alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from careframe.functions.requests import (
    AGENT_LENGTH, audit_action, audit_resource, audit_user, client_ip, is_audited,
)


def audit_from_requests(requests: DataFrame, time_col: str = "ts") -> DataFrame:
    """One audit row per request outside the skipped paths."""
    method, path = F.col("http_method"), F.col("path")
    return requests.filter(is_audited(path)).select(
        "event_id",
        "user_id",
        audit_user(F.col("user_id"), F.col("full_name"), F.col("username")).alias("user_name"),
        audit_action(method, path).alias("action"),
        audit_resource(path).alias("resource_type"),
        F.concat_ws(" ", method, path).alias("description"),
        client_ip(F.col("x_forwarded_for"), F.col("remote_addr")).alias("ip_address"),
        F.substring(F.coalesce("user_agent", F.lit("")), 1, AGENT_LENGTH).alias("user_agent"),
        F.col(time_col).alias("created_at"),
    )
