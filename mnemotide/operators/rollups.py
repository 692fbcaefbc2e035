"""Rollups over nodes, sessions and the ledger."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import MEANING_KINDS, NOT_PROJECTS, PROJECT_MACHINE_PREFIXES, active, days_between, not_void, struggled

INTENT_KINDS = ("decision", "warning", "open_item", "insight", "resolved")
MACHINE_TAG = r"^(entity:|kw:|by:|stance:|distills:|member:|file:|mtime:|ext:|turn:|due:|account:|made:|lesson:|from:|supersedes:|media:|prov:)"


def stats(nodes: DataFrame) -> DataFrame:
    return nodes.agg(
        F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("status") == "active").alias("active"), F.count_if(F.col("status") == "void").alias("void"), F.count_if("flagged").alias("flagged"),
        F.countDistinct("session").alias("sessions"),
    )


def attention(positions: DataFrame) -> DataFrame:
    loads, hits = F.sum("total_loads"), F.sum("compiled_hits")
    return positions.agg(
        F.count(F.lit(1)).alias("tracked"), loads.alias("loads"), hits.alias("hits"), F.count_if((F.col("middle_hits") >= 2) & (F.col("compiled_hits") == 0)).alias("underattended"),
        F.when(loads > 0, hits / loads).otherwise(0.0).alias("efficiency"),
    )


#: What a session's summary counts by name: column and kind.
SUMMARY_KINDS = {"stamps": "context_stamp", "turns": "conversation_turn", "decisions": "decision", "questions": "question", "blockers": "blocker", "resolved": "resolved"}
#: The lists of texts of a summary: name and kind.
SUMMARY_TEXTS = {"stamp_text": "context_stamp", "open_questions": "question", "open_blockers": "blocker"}


def _histogram(value: Column, count: str = "n") -> Column:
    return F.array_join(F.array_sort(F.collect_list(F.concat(value, F.lit("="), F.col(count).cast("string")))), ",")


def session_summary(nodes: DataFrame) -> DataFrame:
    """Totals of each session: nodes, struggles, flags, times, counts of the named kinds, histograms of kinds and of models.

    Its lists of texts, which have no bound, are rows of `session_texts`.
    """
    named = [F.count_if(F.col("kind") == kind).alias(name) for name, kind in SUMMARY_KINDS.items()]
    sums = [F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.count_if("flagged").alias("flagged"), F.count_if(struggled()).alias("struggles"), *named]
    cells = not_void(nodes).groupBy("session", "kind", F.coalesce(F.nullif("model", F.lit("")), F.lit("unknown")).alias("model")).agg(*sums)
    whole = cells.groupBy("session").agg(
        F.sum("n").alias("nodes"), F.sum("flagged").alias("flagged"), F.sum("struggles").alias("struggles"), F.min("first").alias("first_ts"), F.max("last").alias("last_ts"), *[F.sum(c).alias(c) for c in SUMMARY_KINDS]
    )
    for column, name in (("kind", "kinds"), ("model", "models")):
        parts = cells.groupBy("session", column).agg(F.sum("n").alias("n")).groupBy("session").agg(_histogram(F.col(column)).alias(name))
        whole = whole.join(parts, "session")
    return whole


def session_texts(nodes: DataFrame) -> DataFrame:
    """(session, list, ts, id, text): the stamps, questions and active blockers of each session that have a text."""
    name = F.lit(None).cast("string")
    for n, kind in SUMMARY_TEXTS.items():
        name = F.when(F.col("kind") == kind, n).otherwise(name)
    rows = not_void(nodes).where(F.coalesce("query", F.lit("")) != "").withColumn("list", name).where("list is not null")
    return rows.where((F.col("list") != "open_blockers") | (F.col("status") == "active")).select("session", "list", "ts", "id", F.col("query").alias("text"))


def session_tiers(nodes: DataFrame) -> DataFrame:
    return not_void(nodes).groupBy("session").agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("memory_tier") == 0).alias("hot"), F.count_if(F.col("memory_tier") == 1).alias("warm"), F.count_if(F.col("kind").isin(*INTENT_KINDS)).alias("intent"))


def tier_coverage(nodes: DataFrame, embedded: DataFrame) -> DataFrame:
    """Nodes of each tier and the whole percent of them that has a vector."""
    rows = not_void(nodes).join(embedded.select("id", F.lit(1).alias("has")), "id", "left")
    return rows.groupBy("memory_tier").agg(F.count(F.lit(1)).alias("nodes"), F.count("has").alias("embedded"), F.floor(100 * F.count("has") / F.count(F.lit(1))).alias("percent"))


def ledger_by_channel(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("channel").agg(F.count(F.lit(1)).alias("shown"), F.count_if("cited").alias("cited"))


def activity(nodes: DataFrame, as_of: Column, days: float = 7, k: int = 10) -> DataFrame:
    rows = active(nodes).where(days_between(as_of, F.col("ts")).between(0, days))
    return rows.groupBy("session", "model").agg(F.count(F.lit(1)).alias("nodes"), F.max("ts").alias("last_ts")).orderBy(F.desc("nodes"), "session", "model").limit(k)


def volumes(nodes: DataFrame, sessions: DataFrame) -> DataFrame:
    """By account. Nodes are counted by session before they meet the sessions, so the join is small."""
    per = not_void(nodes).groupBy("session").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    rows = per.join(sessions.select(F.col("id").alias("session"), "account"), "session")
    return rows.groupBy(F.coalesce("account", F.lit("unlabeled")).alias("account")).agg(F.count(F.lit(1)).alias("sessions"), F.sum("n").alias("nodes"), F.min("a").alias("first_ts"), F.max("b").alias("last_ts"))


def live_sessions(nodes: DataFrame, k: int = 50) -> DataFrame:
    rows = not_void(nodes).where(~F.startswith("session", F.lit("import-"))).groupBy("session").agg(F.count(F.lit(1)).alias("nodes"), F.max("ts").alias("last_ts"))
    return rows.orderBy(F.desc("last_ts"), "session").limit(k)


def project_chapters(nodes: DataFrame, projects: dict[str, list[str]], per: int = 3) -> DataFrame:
    """(project, kind, nodes, exemplars): counts of each declared project by kind, with its best nodes."""
    names = F.create_map(*[F.lit(x) for p, aliases in projects.items() for a in [p, *aliases] for x in (a, p)])
    rows = active(nodes).select("id", "kind", "importance", "ts", F.explode(F.array_distinct(F.transform("tags", lambda t: names[t]))).alias("project")).where("project is not null")
    best = F.row_number().over(Window.partitionBy("project", "kind").orderBy(F.desc("importance"), F.desc("ts"), "id"))
    return rows.withColumn("r", best).groupBy("project", "kind").agg(F.count(F.lit(1)).alias("nodes"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= per, F.struct("r", "id")))), lambda x: x["id"]), ",").alias("exemplars"))


def family_key(tag: Column) -> Column:
    """One key for spellings of a tag: lower case, without marks around, a possessive, or the s of a plural of over three letters."""
    bare = F.regexp_replace(F.lower(F.trim(tag)), r"(?U)^[^\w]+|[^\w]+$", "")
    bare = F.regexp_replace(bare, r"'s$", "")
    return F.when(F.endswith(bare, F.lit("s")) & (F.length(bare) > 3), F.regexp_replace(bare, "s$", "")).otherwise(bare)


def names_a_project(tag: Column, ignored: tuple[str, ...] = NOT_PROJECTS) -> Column:
    """False for a machine's tags and bare words that name no project."""
    machine = F.lit(False)
    for prefix in PROJECT_MACHINE_PREFIXES:
        machine = machine | F.startswith(tag, F.lit(prefix))
    return ~machine & ~tag.isin(*(ignored or ("",)))


def emerging_families(nodes: DataFrame, declared: list[str], least_nodes: int = 6, least_sessions: int = 2, least_days: int = 2, ignored: tuple[str, ...] = NOT_PROJECTS) -> DataFrame:
    """Undeclared tags that recur: distinct nodes, sessions and days, named by the commonest spelling."""
    rows = active(nodes).select("id", "session", "ts", F.explode("tags").alias("tag")).where(names_a_project(F.col("tag"), ignored) & ~F.col("tag").isin(*declared))
    rows = rows.withColumn("family", family_key(F.col("tag"))).where("family <> ''")
    spelled = rows.groupBy("family", "tag").agg(F.count(F.lit(1)).alias("n")).groupBy("family").agg(F.max_by("tag", F.struct("n", "tag")).alias("display"))
    whole = rows.groupBy("family").agg(F.countDistinct("id").alias("nodes"), F.countDistinct("session").alias("sessions"), F.countDistinct(F.to_date("ts")).alias("days"), F.max("ts").alias("last_ts"))
    return whole.where((F.col("nodes") >= least_nodes) & (F.col("sessions") >= least_sessions) & (F.col("days") >= least_days)).join(spelled, "family")


def _gathered(nodes: DataFrame, needle: str) -> DataFrame:
    """Active nodes and their tags that hold the needle's letters and digits, once the tag's machine prefix is gone."""
    prefix = "^(" + "|".join(PROJECT_MACHINE_PREFIXES) + ")"
    want = re.sub("[^a-z0-9]+", "", re.sub(prefix, "", needle.lower()))
    holds = F.contains(F.regexp_replace(F.regexp_replace(F.lower("tag"), prefix, ""), "[^a-z0-9]+", ""), F.lit(want)) if len(want) >= 3 else F.lit(False)
    return active(nodes).withColumn("tag", F.explode("tags")).where(holds)


def deep_gather(nodes: DataFrame, needle: str, k: int = 24) -> DataFrame:
    """The k commonest tags that hold the needle, with counts."""
    return _gathered(nodes, needle).groupBy("tag").agg(F.countDistinct("id").alias("nodes")).orderBy(F.desc("nodes"), "tag").limit(k)


def gather_total(nodes: DataFrame, needle: str, samples: int = 3) -> DataFrame:
    """One row (total, samples): the distinct nodes that `deep_gather` counts, and the gists of the first of them."""
    best = [F.nullif(F.col(c), F.lit("")) for c in ("gist",) if c in nodes.columns]
    gist = F.translate(F.coalesce(*best, F.substring("query", 1, 90), F.lit("")), "\n", " ")
    hits = _gathered(nodes, needle).select("id", "ts", gist.alias("gist")).dropDuplicates(["id"])
    first = hits.orderBy("ts", "id").limit(samples).agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "id", "gist"))), lambda x: x["gist"]).alias("samples"))
    return hits.agg(F.count(F.lit(1)).alias("total")).join(F.broadcast(first))


def tag_hubs(nodes: DataFrame, k: int = 24) -> DataFrame:
    rows = active(nodes).select(F.explode("tags").alias("tag")).where("not startswith(tag, 'member:') and tag not in ('backfill', 'consolidated')")
    return rows.groupBy("tag").agg(F.count(F.lit(1)).alias("nodes")).orderBy(F.desc("nodes"), "tag").limit(k)


def tag_index(nodes: DataFrame, least: int = 2, k: int = 1000) -> DataFrame:
    rows = active(nodes).select(F.explode("tags").alias("tag")).where(~F.rlike("tag", F.lit(MACHINE_TAG)))
    return rows.groupBy("tag").agg(F.count(F.lit(1)).alias("nodes")).where(F.col("nodes") >= least).orderBy(F.lower("tag"), "tag").limit(k)


def topics(nodes: DataFrame, gated: bool = False) -> DataFrame:
    """Communities with their shares of distilled and meaningful nodes. Those of 20 nodes or more that are over 80
    percent distilled are gated: left out, or alone in the result with `gated`. Unnamed and numbered ones drop."""
    label = F.substring_index("community", "|", -1)
    rows = active(nodes).where(F.contains("community", F.lit("|"))).select(F.substring_index("community", "|", 1).alias("cid"), label.alias("label"), "ts", F.array_contains("tags", "prov:distilled").alias("d"), F.col("kind").isin(*MEANING_KINDS).alias("m"))
    rows = rows.where(~F.rlike("label", F.lit(r"^\d+$")) & ~F.col("label").isin("", "unlabeled"))
    out = rows.groupBy("cid", "label").agg(F.count(F.lit(1)).alias("total"), F.count_if("d").alias("distilled"), F.count_if("m").alias("meaning"), F.max(F.when(F.col("m"), F.col("ts"))).alias("last_meaning"))
    gate = (F.col("total") >= 20) & (F.col("distilled") / F.col("total") > 0.8)
    return out.where(gate if gated else ~gate)


def weekly_families(nodes: DataFrame, as_of: Column, projects: dict[str, tuple[str, list[str]]], days: float = 7, least: int = 3, ignored: tuple[str, ...] = NOT_PROJECTS) -> DataFrame:
    """(tag, name, nodes, sessions, approx, declared): the families that nodes of the last days belong to, imports left out.

    Declared projects (tag: (name, aliases)) have their names and always show; others are named by their commonest spelling
    and need `least` nodes. approx: all nodes of those days in the sessions that hold the family's. A row without a tag
    counts the nodes of no family. Sort by (declared, nodes), descending, to read it.
    """
    week = active(nodes).where((days_between(as_of, F.col("ts")) <= days) & ~F.startswith("session", F.lit("import-"))).select("id", "session", "tags")
    held = F.create_map(*[F.lit(x) for t, (_, aliases) in projects.items() for a in dict.fromkeys([t, *aliases]) for x in (a, t)]) if projects else None
    tagged = week.select("id", "session", F.explode("tags").alias("tag"))
    tagged = tagged.withColumn("project", held[F.col("tag")] if held is not None else F.lit(None).cast("string"))
    family = F.when(F.col("project").isNull() & names_a_project(F.col("tag"), ignored), family_key(F.col("tag")))
    tagged = tagged.withColumn("family", family).where("project is not null or family <> ''")
    # a family's sessions meet the week's counts of sessions, a row for each family and session
    cells = tagged.groupBy("project", "family", "session").agg(F.countDistinct("id").alias("n"))
    per = week.groupBy("session").agg(F.count(F.lit(1)).alias("all"))
    whole = cells.join(per, "session", "left").groupBy("project", "family").agg(F.sum("n").alias("nodes"), F.count("session").alias("sessions"), F.coalesce(F.sum("all"), F.lit(0)).alias("approx"))
    spelled = tagged.where("project is null").groupBy("family", "tag").agg(F.count(F.lit(1)).alias("n")).groupBy("family").agg(F.max_by("tag", F.struct("n", "tag")).alias("spelling"))
    names = F.create_map(*[F.lit(x) for t, (name, _) in projects.items() for x in (t, name)])[F.col("project")] if projects else F.lit(None).cast("string")
    declared = F.col("project").isNotNull()
    rows = whole.join(spelled, "family", "left").where(declared | (F.col("nodes") >= least))
    rows = rows.select(F.coalesce("project", "spelling").alias("tag"), F.coalesce(names, F.col("spelling")).alias("name"), "nodes", "sessions", "approx", declared.alias("declared"))
    none = week.join(tagged.select("id").distinct(), "id", "left_anti").agg(F.count(F.lit(1)).alias("nodes"))
    zero = F.lit(0).cast("long")
    return rows.unionAll(none.select(F.lit(None).cast("string"), F.lit("untagged"), "nodes", zero, zero, F.lit(False)))


def page_one(nodes: DataFrame, as_of: Column) -> DataFrame:
    recent = days_between(as_of, F.col("ts")).between(0, 14)
    return active(nodes).agg(F.count(F.lit(1)).alias("nodes"), F.count_if(recent).alias("recent"), F.count_if(recent & (F.col("kind") == "decision")).alias("decisions"), F.count_if(F.col("kind") == "open_item").alias("open_items"))


def backfill_plan(turns: DataFrame, done: DataFrame, rate: float = 0.35) -> DataFrame:
    """Characters of the sessions that are still to be distilled, and the tokens that may take."""
    rows = turns.join(done.select("session"), "session", "left_anti")
    chars = F.sum(F.greatest(F.length("query"), F.length("text")))
    return rows.groupBy("session").agg(F.count(F.lit(1)).alias("turns"), chars.alias("chars"), F.floor(F.round(chars * rate, 6)).alias("tokens"))


def entity_bridges(nodes: DataFrame, least: int = 2, k: int = 25) -> DataFrame:
    rows = active(nodes).select("session", F.explode("tags").alias("tag")).where("startswith(tag, 'entity:')")
    return rows.groupBy("tag").agg(F.countDistinct("session").alias("sessions"), F.count(F.lit(1)).alias("nodes")).where(F.col("sessions") >= least).orderBy(F.desc("sessions"), "tag").limit(k)


def account_harnesses(sessions: DataFrame) -> DataFrame:
    rows = sessions.groupBy("account").agg(F.count(F.lit(1)).alias("sessions"), F.sum("node_count").alias("nodes"), F.array_join(F.array_sort(F.collect_set("harness")), ",").alias("harnesses"))
    return rows


def child_counts(nodes: DataFrame) -> DataFrame:
    return active(nodes).where("parent is not null").groupBy("parent").agg(F.count(F.lit(1)).alias("children"))


def model_attribution(nodes: DataFrame) -> DataFrame:
    return active(nodes).groupBy("model").agg(F.count(F.lit(1)).alias("nodes"), F.count_if(struggled()).alias("struggles"), F.count_if("flagged").alias("flags"), F.min_by("agent_role", F.struct("ts", "id")).alias("first_role"))


def centroids(points: DataFrame, k: int = 80) -> DataFrame:
    return points.groupBy("cid").agg(F.count(F.lit(1)).alias("n"), F.avg("map_x").alias("x"), F.avg("map_y").alias("y")).orderBy(F.desc("n"), "cid").limit(k)


def session_upsert(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Sessions after new nodes: the first start, counts added; an account changes only where the stored one is not
    locked and the incoming one is; a lock stays."""
    new = incoming.groupBy("session").agg(F.min("ts").alias("t"), F.count(F.lit(1)).alias("n"), F.min_by(F.when(F.col("account_locked"), F.col("account")), F.when(F.col("account_locked"), F.col("ts"))).alias("proven"), F.first("account", ignorenulls=True).alias("any"), F.bool_or("account_locked").alias("lock"))
    rows = existing.join(new.withColumnRenamed("session", "id"), "id", "full")
    account = F.when(F.col("account").isNull(), F.coalesce("proven", "any")).when(~F.coalesce("account_locked", F.lit(False)) & F.col("proven").isNotNull(), F.col("proven")).otherwise(F.col("account"))
    return rows.select("id", F.least("started_at", "t").alias("started_at"), (F.coalesce("node_count", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("node_count"), account.alias("account"), (F.coalesce("account_locked", F.lit(False)) | F.coalesce("lock", F.lit(False))).alias("account_locked"))
