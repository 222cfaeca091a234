"""The run listing: composable predicates, orderings and pages."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROLES = ("main", "context", "subagent")


@dataclass(frozen=True)
class RunFilter:
    """Predicates over runs; those left at None don't apply.

    Columns used: collection, task_key, group_key, outcome, reward_outcome, episode_head, ready, issues
    (array of struct with key), flags, labels (arrays), human_status, role, title, instruction, run_id_text,
    task_id, tier, masked, r, has_errors, failed_checks (array of struct with id).
    """

    collection: str | None = None
    task_key: str | None = None
    group_key: str | None = None
    outcome: str | None = None
    heads_only: bool = False
    ready: bool | None = None
    issue: str | None = None
    flag: str | None = None
    label: str | None = None
    reviewed: bool | None = None
    search: str | None = None
    tier: int | str | None = None
    reward_errors: bool | None = None
    r_min: float | None = None
    r_max: float | None = None
    failed_check: str | None = None
    roles: Sequence[str] | None = None

    def condition(self, columns: Sequence[str]) -> Column:
        parts: list[Column] = [F.lit(True)]
        for name in ("collection", "task_key", "group_key"):
            if getattr(self, name) is not None:
                parts.append(F.col(name) == getattr(self, name))
        if self.outcome is not None:
            own = F.col("outcome")
            parts.append((F.coalesce("reward_outcome", own) if "reward_outcome" in columns else own) == self.outcome)
        if self.heads_only:
            parts.append(F.col("episode_head"))
        if self.ready is not None:
            parts.append(F.col("ready") == self.ready)
        if self.issue is not None:
            parts.append(F.exists("issues", lambda x: x["key"] == self.issue))
        if self.flag is not None:
            parts.append(F.array_contains("flags", self.flag))
        if self.label is not None:
            parts.append(F.array_contains("labels", self.label))
        if self.reviewed is not None:
            parts.append(F.col("human_status").isNotNull() == F.lit(self.reviewed))
        if self.search:
            wanted = F.lower(F.lit(self.search))
            found = [F.contains(F.lower(F.coalesce(c, F.lit(""))), wanted) for c in ("title", "instruction", "run_id_text", "task_id") if c in columns]
            parts.append(any_of(found))
        if self.tier is not None:
            rewarded = F.col("masked").isNotNull()
            parts.append({"none": ~rewarded, "any": rewarded, "masked": F.coalesce("masked", F.lit(False))}.get(self.tier, F.col("tier") == self.tier) if isinstance(self.tier, str) else F.col("tier") == self.tier)
        if self.reward_errors is not None:
            parts.append(F.col("has_errors") == self.reward_errors)
        if self.r_min is not None:
            parts.append(F.col("r") >= self.r_min)
        if self.r_max is not None:
            parts.append(F.col("r") <= self.r_max)
        if self.failed_check is not None:
            parts.append(F.exists("failed_checks", lambda x: x["id"] == self.failed_check))
        if self.roles is not None:
            parts.append(F.coalesce("role", F.lit("main")).isin(*self.roles))
        condition = parts[0]
        for part in parts[1:]:
            condition = condition & part
        return condition


def any_of(conditions: Sequence[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def orderings(tie: str = "run_id") -> dict[str, list[Column]]:
    """The orders in which runs are listed; ``tie`` makes each total."""
    role = F.coalesce(*[F.when(F.coalesce("role", F.lit("main")) == r, i) for i, r in enumerate(ROLES)], F.lit(len(ROLES)))
    return {
        "newest": [F.desc("imported_at"), F.asc(tie)],
        "steps": [F.desc("steps"), F.asc(tie)],
        "errors": [F.desc("tool_errors"), F.asc(tie)],
        "duration": [F.desc_nulls_last("duration_ms"), F.asc(tie)],
        "tokens": [F.desc_nulls_last("tokens"), F.asc(tie)],
        "score": [F.asc_nulls_last("outcome_score"), F.asc(tie)],
        "reward_high": [F.desc_nulls_last("r"), F.asc(tie)],
        "reward_low": [F.asc_nulls_last("r"), F.asc(tie)],
        "episode": [F.asc("group_key"), role.asc(), F.asc_nulls_first("segment"), F.asc(tie)],
        "title": [F.asc_nulls_last("title"), F.asc(tie)],
    }


def page(rows: DataFrame, order: Sequence[Column], limit: int = 100, offset: int = 0) -> DataFrame:
    """One page of the rows in order: 1 to 1,000 of them. Spark keeps only the first offset + limit rows of each
    partition."""
    return rows.orderBy(*order).offset(max(0, offset)).limit(min(1000, max(1, limit)))


def message_page(messages: DataFrame, offset: int, limit: int = 100) -> DataFrame:
    """A page of each run's messages; an offset past the end gives the last message."""
    w = Window.partitionBy("run_id")
    numbered = messages.withColumn("_nth", F.row_number().over(w.orderBy("step"))).withColumn("_n", F.count("*").over(w))
    start = F.least(F.lit(max(0, offset)), F.col("_n") - 1)
    return numbered.where((F.col("_nth") > start) & (F.col("_nth") <= start + min(500, max(1, limit)))).drop("_nth", "_n")


def with_member_flag(heads: DataFrame, members: DataFrame, flag: Column) -> DataFrame:
    """Episode heads of which any member has the flag: a hash semi-join on the episode's key."""
    marked = members.where(flag).select("collection", "episode_key").distinct()
    return heads.join(marked, ["collection", "episode_key"], "left_semi")


def filter_messages(messages: DataFrame, roles: Sequence[str] | None = None, search: str | None = None, steps: Sequence[int] | None = None, tool: str | None = None) -> DataFrame:
    """Messages by role, text, step, or a call of a tool (array of struct ``tools``)."""
    if roles is not None:
        messages = messages.where(F.col("role").isin(*roles))
    if search:
        messages = messages.where(F.contains(F.lower(F.col("text")), F.lower(F.lit(search))))
    if steps is not None:
        messages = messages.where(F.col("step").isin(*steps))
    if tool is not None:
        messages = messages.where(F.exists("tools", lambda t: t["name"] == tool))
    return messages


def expand_heads(heads: DataFrame, members: DataFrame) -> DataFrame:
    """All members of the given episodes, each once."""
    return members.join(heads.select("collection", "episode_key").distinct(), ["collection", "episode_key"], "left_semi")
