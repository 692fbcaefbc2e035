"""Predicates and projections over nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import active, days_between, not_void, struggled

# Tags of automatic processes, and of what a person captured.
PROCESS_TAGS = ("backfill", "consolidated", "prov:distilled", "audit", "registry-row")
HUMAN_TAG = "human-capture"


def struggles(nodes: DataFrame, k: int | None = None) -> DataFrame:
    """Slow, empty or sparse tool calls, the slowest first."""
    rows = not_void(nodes).where(struggled()).orderBy(F.desc_nulls_last("latency_ms"), "id")
    return rows if k is None else rows.limit(k)


def report_struggles(nodes: DataFrame) -> DataFrame:
    """The session report's own rule: over 800 ms, or one result or none."""
    return active(nodes).where((F.col("kind") == "tool_call") & (F.coalesce(F.col("latency_ms") > 800, F.lit(False)) | F.coalesce(F.col("result_count") <= 1, F.lit(False))))


def live(nodes: DataFrame) -> DataFrame:
    """Neither imported nor distilled."""
    return nodes.where(~F.startswith("session", F.lit("import-")) & ~F.array_contains("tags", "prov:distilled"))


def any_tag(tags: list[str]) -> Column:
    return F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags]))


def is_process() -> Column:
    return any_tag(list(PROCESS_TAGS)) & ~F.array_contains("tags", HUMAN_TAG)


def maturity() -> Column:
    return F.when((F.col("kind") == "procedure") | (F.col("stability_days") >= 30), "evergreen").when(F.col("stability_days") >= 3, "budding").otherwise("seedling")


def like_literal(text: str) -> str:
    """A pattern for LIKE ... ESCAPE '\\' that matches the text itself."""
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def hidden_ids(archived: DataFrame, snoozed: DataFrame, now: Column) -> DataFrame:
    """Archived, or snoozed until later than now."""
    return archived.select("id").union(snoozed.where(F.col("until") > now).select("id")).distinct()


def live_log(nodes: DataFrame, limit: int = 20, kind: str | None = None, session_prefix: str | None = None, contains: str | None = None, unembedded: bool = False) -> DataFrame:
    rows = active(nodes)
    if kind:
        rows = rows.where(F.col("kind") == kind)
    if session_prefix:
        rows = rows.where(F.startswith("session", F.lit(session_prefix)))
    if contains:
        rows = rows.where(F.contains(F.lower(F.concat_ws(" ", "query", "output_preview")), F.lit(contains.lower())))
    if unembedded:
        rows = rows.where("embedding is null")
    return rows.orderBy(F.desc("ts"), "id").limit(max(1, min(60, limit)))


def recent_set(nodes: DataFrame, limit: int = 12) -> DataFrame:
    return active(nodes).where(F.col("kind").isin("decision", "warning", "open_item", "insight", "resolved")).orderBy(F.desc("ts"), "id").limit(limit)


def day_view(nodes: DataFrame, day: Column) -> DataFrame:
    """Nodes of one day in the session's time zone, without imports."""
    start = F.date_trunc("day", day)
    return active(nodes).where((F.col("ts") >= start) & (F.col("ts") < start + F.expr("interval 1 day")) & ~F.startswith("session", F.lit("import-")))


def node_card() -> list[Column]:
    """Display fields; 0 and empty count as missing, as the tier's and importance's defaults show."""
    def some(c, default):
        return F.when(F.col(c).isNull() | (F.col(c) == (0 if not isinstance(default, str) else "")), F.lit(default)).otherwise(F.col(c)).alias(c)

    return [F.col("id"), F.col("kind"), some("query", ""), some("memory_tier", 1), some("importance", 5), some("model", "unknown")]


def just_landed(nodes: DataFrame, hidden: DataFrame, before: Column, pool: int = 40, limit: int = 10) -> DataFrame:
    """Paging by time: the pool is taken first and hidden ids drop out of it after, so a page can be short."""
    page = active(nodes).where(F.col("ts") < before).orderBy(F.desc("ts"), "id").limit(pool)
    return page.join(hidden, "id", "left_anti").orderBy(F.desc("ts"), "id").limit(limit)


def age_days(as_of: Column) -> Column:
    return days_between(as_of, F.col("ts"))
