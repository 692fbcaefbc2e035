"""What people do with memories, as appended nodes and changes: done, undone, research, replies, promotion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import without_due
from .rollups import MACHINE_TAG

# Tags that say how a node came to be and never what it is about, by their beginnings.
ORIGIN_TAGS = r"^(garden|human-capture|inbox|promoted|annotation|quiet|memory|backfill|consolidated|import)"


def _written(rows: DataFrame, verb: str, kind: Column, query: Column, tags: Column, at: Column, session: str, preview: Column | None = None, tier: Column | None = None) -> DataFrame:
    """Nodes that a person wrote about others: chained to them, dated now, with ids that follow from both."""
    return rows.select(
        F.substring(F.sha2(F.concat_ws("|", F.lit(verb), "id", query, at.cast("string")), 256), 1, 12).alias("id"), F.lit(session).alias("session"), kind.alias("kind"), query.alias("query"), (query if preview is None else preview).alias("output_preview"),
        F.col("id").alias("parent"), F.lit("human").alias("model"), F.lit("user").alias("speaker"), F.lit("curator").alias("agent_role"), (F.lit(1) if tier is None else tier).alias("memory_tier"), tags.alias("tags"), F.lit("active").alias("status"), at.alias("ts"),
    )


def _voided(ids: DataFrame, at: Column) -> DataFrame:
    return ids.select("id", F.lit("status").alias("field"), F.lit("void").alias("value"), at.alias("at")).distinct()


def _asked(nodes: DataFrame, requests: DataFrame) -> DataFrame:
    """Nodes that requests (id, note) name, with the note; a request that names none writes nothing."""
    return nodes.join(requests.groupBy("id").agg(F.max("note").alias("note")), "id")


def _array(*words: str) -> Column:
    return F.array(*[F.lit(w) for w in words])


def done(nodes: DataFrame, requests: DataFrame, at: Column, session: str) -> tuple[DataFrame, DataFrame]:
    """(resolutions, changes): a resolved node chained to each item, with the note or the item's start, and the item void."""
    rows = _asked(nodes, requests)
    text = F.coalesce(F.nullif("note", F.lit("")), F.concat(F.lit("done: "), F.substring(F.coalesce("query", F.lit("")), 1, 200)))
    return _written(rows, "done", F.lit("resolved"), text, _array("garden", "desk-done"), at, session), _voided(rows, at)


def undone(nodes: DataFrame, receipts: DataFrame, at: Column, session: str) -> tuple[DataFrame, DataFrame]:
    """(items, changes): what mistaken receipts (id) had closed, raised again as new nodes chained to the old ones, and the
    receipts void. Nothing that is void comes back to life."""
    marked = nodes.join(receipts.select("id").distinct(), "id", "left_semi").where("kind = 'resolved' and parent is not null").select(F.col("id").alias("receipt"), F.col("parent").alias("id"))
    rows = nodes.join(marked, "id")
    tags = F.concat(F.filter(F.coalesce("tags", F.array().cast("array<string>")), lambda t: t != "restored-after-misclick"), _array("restored-after-misclick"))
    items = _written(rows, "undone", F.coalesce("kind", F.lit("open_item")), F.col("query"), tags, at, session, F.coalesce(F.nullif("output_preview", F.lit("")), "query", F.lit("")))
    return items, _voided(rows.select(F.col("receipt").alias("id")), at)


def research(nodes: DataFrame, requests: DataFrame, at: Column, session: str) -> DataFrame:
    """Open items that ask for research on ideas; findings go on the idea itself."""
    rows = _asked(nodes, requests)
    text = F.concat(F.lit("RESEARCH: "), F.substring(F.coalesce("query", F.lit("")), 1, 300))
    note = F.coalesce(F.nullif("note", F.lit("")), F.lit("requested from the Ideas tab — findings go on the idea node"))
    return _written(rows, "research", F.lit("open_item"), text, _array("research-queue", "garden"), at, session, note)


def replies(nodes: DataFrame, notes: DataFrame, at: Column, session: str, most: int = 8000) -> DataFrame:
    """Notes (id, text, memory) hung on nodes: kept ones are warm and join retrieval, others are cold and quiet."""
    text = F.substring(F.trim("text"), 1, most)
    rows = notes.where(F.trim(F.coalesce("text", F.lit(""))) != "").join(nodes.select("id"), "id", "left_semi")
    kept = F.coalesce("memory", F.lit(False))
    return _written(rows, "reply", F.lit("note"), text, F.array(F.lit("annotation"), F.lit("garden"), F.when(kept, "memory").otherwise("quiet")), at, session, text, F.when(kept, 1).otherwise(2))


def promoted(nodes: DataFrame, requests: DataFrame, at: Column, session: str, declared: tuple[str, ...] = ()) -> DataFrame:
    """New ideas or open items (requests: id, kind) from the gist of other nodes, chained to them, without their due dates.

    They take over the tags that name what the source is about: declared projects, and what no process put there.
    """
    best = [F.nullif(F.col(c), F.lit("")) for c in ("gist", "query", "output_preview") if c in nodes.columns]
    text = F.substring(F.trim(without_due(F.trim(F.coalesce(*best, F.lit(""))))), 1, 300)
    rows = nodes.join(requests.where("kind in ('idea', 'open_item')").groupBy("id").agg(F.min("kind").alias("to")), "id").withColumn("_text", text).where("_text <> ''")
    about = F.filter(F.coalesce("tags", F.array().cast("array<string>")), lambda t: t.isin(*(declared or ("",))) | (~F.rlike(t, F.lit(MACHINE_TAG)) & ~F.rlike(t, F.lit(ORIGIN_TAGS))))
    return _written(rows, "promoted", F.col("to"), F.col("_text"), F.concat(about, _array("promoted")), at, session)
