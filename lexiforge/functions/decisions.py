"""Decision tables: gates as data, tried in order, the first that applies decides.

A gate is a condition in SQL over the row's columns and what it decides. A table compiles to
one expression, so a decision is a struct that costs one pass.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Gate:
    """``when`` is SQL that tells whether the gate applies (null: it doesn't); the others are what it decides, ``retry`` the SQL of a time."""

    when: str
    state: str
    reason: str
    recovery: str = "none"
    action: str = "none"
    retry: str | None = None

    def decision(self) -> Column:
        retry = F.expr(self.retry).cast("long") if self.retry else F.lit(None).cast("long")
        return F.struct(*[F.lit(v).alias(n) for n, v in (("state", self.state), ("reason", self.reason), ("recovery", self.recovery), ("action", self.action))], retry.alias("retry_at"))


def decide(gates: list[Gate]) -> Column:
    """(state, reason, recovery, action, retry_at) of the first gate that applies; null if none does."""
    return F.coalesce(*[F.when(F.expr(g.when), g.decision()) for g in gates], F.lit(None))


def sql(gates: list[Gate], field: str) -> str:
    """One field of the same decision as a CASE expression."""
    value = lambda g: (g.retry or "NULL") if field == "retry_at" else f"'{getattr(g, field)}'"
    return f"CASE {' '.join(f'WHEN {g.when} THEN {value(g)}' for g in gates)} END"


# Fixed table: whether a provider is given work, and if not, why, who can change it and how.
ADMISSION = [
    Gate("NOT enabled", "disabled", "disabled", "configuration", "enable_provider"),
    Gate("global_paused", "closed", "operator_paused", "operator", "resume_all"),
    Gate("paid_work_paused", "closed", "paid_work_paused", "operator", "resume_paid"),
    Gate("budget = 'unarmed'", "closed", "budget_unarmed", "operator", "arm_budget"),
    Gate("budget IN ('exhausted', 'closed')", "closed", "budget_exhausted", "operator", "rearm_budget"),
    Gate("resources = 'waiting'", "closed", "resource_wait", "automatic", "none", "next_probe_at"),
    Gate("credentials = 'absent'", "closed", "auth_wait", "operator", "restore_auth", "credentials_retry_at"),
    Gate("credentials <> 'ready'", "waiting", "auth_wait", "automatic", "none", "credentials_retry_at"),
    Gate("authentication = 'waiting'", "waiting", "auth_wait", "automatic", "restore_auth", "authentication_retry_at"),
    Gate("quota = 'waiting'", "waiting", "codex_quota_wait", "automatic", "none", "quota_retry_at"),
    Gate("provider = 'network_wait'", "waiting", "network_wait", "automatic", "none", "provider_retry_at"),
    Gate("provider = 'rate_limited'", "waiting", "rate_limit_wait", "automatic", "none", "provider_retry_at"),
    Gate("provider = 'backoff'", "waiting", "provider_backoff", "automatic", "inspect_provider", "provider_retry_at"),
    Gate("provider <> 'ready'", "waiting", "provider_backoff", "automatic", "none", "provider_retry_at"),
    Gate("scheduler = 'circuit_open'", "closed", "circuit_open", "operator", "inspect_provider"),
    Gate("scheduler = 'error_dampener'", "waiting", "error_dampener", "automatic", "none", "next_wake_at"),
    Gate("scheduler = 'launch_pacing'", "limited", "launch_pacing", "automatic", "none", "next_wake_at"),
    Gate("scheduler = 'at_capacity'", "limited", "at_capacity", "none", "none", "next_wake_at"),
    Gate("scheduler = 'adaptive' OR selected_concurrency < configured_concurrency", "limited", "adaptive_capacity"),
    Gate("active_invocations > 0", "open", "active"),
    Gate("ready_work > 0", "open", "ready"),
    Gate("true", "open", "no_ready_work"),
]

# Fixed table: the state of a source of pages, by words of the reason for which it stopped, else by its gate.
ORIGIN = [
    Gate("NOT configured", "disabled", "not_configured"),
    Gate("contains(stop_reason, 'HUMAN_REQUIRED') OR contains(stop_reason, 'CHALLENGE')", "challenge_wait", "stopped"),
    Gate("contains(stop_reason, 'NETWORK')", "network_wait", "stopped"),
    Gate("contains(stop_reason, 'RATE_LIMIT')", "rate_wait", "stopped"),
    Gate("contains(stop_reason, 'DISK') OR contains(stop_reason, 'STORAGE') OR contains(stop_reason, 'CAPACITY')", "disk_wait", "stopped"),
    Gate("stop_reason <> ''", "blocked", "stopped"),
    Gate("consecutive_failures > 0 AND greatest(cooldown_until, next_allowed_at) > now_ms", "blocked", "cooling", retry="greatest(cooldown_until, next_allowed_at)"),
    Gate("runtime_state IS NOT NULL", "as_reported", "runtime"),
    Gate("true", "healthy", "none"),
]

# Fixed table: what a monitor shows of a status document: of another writer, too old, with blockers, weakened, or well.
MONITOR = [
    Gate("document_id IS NULL", "unavailable", "no_document"),
    Gate("document_id <> expected_id", "unavailable", "identity_mismatch", "operator", "check_writer"),
    Gate("observed_at > now_ms + 60000", "unavailable", "clock_skew"),
    Gate("now_ms - observed_at > stale_after", "stale", "too_old", "automatic", "none", "observed_at + stale_after"),
    Gate("blockers > 0", "blocked", "blockers"),
    Gate("warnings > 0", "degraded", "warnings"),
    Gate("true", "healthy", "none"),
]
