"""Views over one node, project, topic or day, and the small writes that workflows make."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import MEANING_KINDS, active, days_between, not_void
from ..scratch import Scratch
from .filters import maturity
from .graph import fnv1a
from .windows import placed


def thread(nodes: DataFrame, most: int = 3) -> DataFrame:
    """(id, previous, next): every node's parent and its first few children, earliest first."""
    kids = active(nodes).where("parent is not null").select("parent", "id", "ts").withColumn("r", F.row_number().over(Window.partitionBy("parent").orderBy("ts", "id"))).where(F.col("r") <= most)
    kids = kids.groupBy(F.col("parent").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", F.col("id").alias("k")))), lambda x: x["k"]), ",").alias("next"))
    return nodes.select("id", F.col("parent").alias("previous")).join(kids, "id", "left").select("id", "previous", F.coalesce("next", F.lit("")).alias("next"))


def previous_sessions(compiled: DataFrame) -> DataFrame:
    """(session, previous): the other session that was compiled last before each; `compiled` has session and at."""
    last = compiled.groupBy("session").agg(F.max("at").alias("at"))
    buckets = last.withColumn("day", F.to_date("at"))
    w = Window.partitionBy("day").orderBy("at", "session")
    inside = buckets.withColumn("p", F.lag("session").over(w))
    # the last of each day stands for the days after it, so one small window runs over days
    ends = buckets.groupBy("day").agg(F.max_by("session", F.struct("at", "session")).alias("last")).withColumn("before", F.lag("last").over(Window.orderBy("day")))
    return inside.join(ends.select("day", "before"), "day").select("session", F.coalesce("p", "before").alias("previous"))


def cross_view(nodes: DataFrame, k: int = 900) -> DataFrame:
    """The nodes that a view over everything shows: meaning first, then importance and time."""
    return active(nodes).orderBy(F.when(F.col("kind").isin(*MEANING_KINDS), 0).otherwise(1), F.desc("importance"), F.desc("ts"), "id").limit(k)


def strongest(edges: DataFrame, node: str, k: int = 40) -> DataFrame:
    """A node's edges by tier and weight."""
    rank = F.when(F.col("tier") == "strong", 0).when(F.col("tier") == "medium", 1).when(F.col("tier") == "weak", 2).otherwise(3)
    own = edges.where((F.col("src") == node) | (F.col("dst") == node))
    return own.select(F.when(F.col("src") == node, F.col("dst")).otherwise(F.col("src")).alias("other"), "type", "tier", "weight", rank.alias("rank")).orderBy("rank", F.desc("weight"), "other", "type").limit(k).drop("rank")


def provenance(rows: DataFrame, sessions: DataFrame) -> DataFrame:
    """`rows` with origin: account and harness of the session, as far as known."""
    s = sessions.select(F.col("id").alias("session"), F.concat_ws("/", "account", "harness").alias("origin"))
    return rows.join(s, "session", "left")


def graph_payload(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges of which both ends are among the shown nodes."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def galaxy_bodies(points: DataFrame, floor: float = 80.0) -> DataFrame:
    """(galaxy, x, y, body): centres, and the largest distance of a member from its centre."""
    centres = points.groupBy("galaxy").agg(F.avg("map_x").alias("x"), F.avg("map_y").alias("y"))
    # written, so that it joins as a table; grouping by the struct lets a large galaxy's side of the join be split among tasks
    centres = Scratch(points.sparkSession, "galaxies").save(centres).select("galaxy", F.struct("galaxy", "x", "y").alias("c"))
    far = points.join(centres, "galaxy").groupBy("c").agg(F.max(F.hypot(F.col("map_x") - F.col("c.x"), F.col("map_y") - F.col("c.y"))).alias("d"))
    return far.select("c.galaxy", "c.x", "c.y", F.greatest(F.lit(floor), "d").alias("body"))


def live_fill(fresh: DataFrame, points: DataFrame) -> DataFrame:
    """(id, map_x, map_y) for new nodes (id, ts, cid, galaxy) without places, beside `points`, the placed ones.

    The i-th new node, by time and id, lies 18 + 6i from its community's centre, a golden angle further than the last.
    One whose community has no placed node lies in its galaxy's halo, between 1.05 and 1.7 times the body from the centre
    as the hash of its id says; in a galaxy without placed nodes the body is 200 around the origin. No node is left out.
    """
    scratch = Scratch(points.sparkSession, "fill")
    centres = scratch.save(points.where("cid is not null").groupBy("cid").agg(F.avg("map_x").alias("bx"), F.avg("map_y").alias("by")))
    bodies = scratch.save(galaxy_bodies(points)).select("galaxy", F.col("x").alias("gx"), F.col("y").alias("gy"), "body")
    rows = placed(fresh.select("ts", "id", "cid", "galaxy"), ["ts", "id"], scratch)
    rows = rows.join(centres, "cid", "left").join(bodies, "galaxy", "left")
    turn, off = (F.col("i") + 1) * F.lit(math.pi * (3 - math.sqrt(5))), 18.0 + 6.0 * F.col("i")
    h = fnv1a(F.col("id"))
    low, high = F.pmod(h, F.lit(1 << 20)) / 1048575.0, F.floor(h / (1 << 20)) / 4095.0
    far, angle = F.coalesce("body", F.lit(200.0)) * F.sqrt(1.1 + 1.8 * low), high * 6.2831853
    settled = F.col("bx").isNotNull()
    x = F.when(settled, F.col("bx") + off * F.cos(turn)).otherwise(F.coalesce("gx", F.lit(0.0)) + far * F.cos(angle))
    y = F.when(settled, F.col("by") + off * F.sin(turn)).otherwise(F.coalesce("gy", F.lit(0.0)) + far * F.sin(angle))
    return rows.select("id", F.round(x, 2).alias("map_x"), F.round(y, 2).alias("map_y"))


def shown_places(points: DataFrame, fresh: DataFrame) -> DataFrame:
    """(id, map_x, map_y, fresh): placed nodes and, beside them, new ones with provisional places."""
    return points.select("id", "map_x", "map_y", F.lit(False).alias("fresh")).unionByName(live_fill(fresh, points).withColumn("fresh", F.lit(True)))


def stable_places(members: DataFrame, known: DataFrame) -> DataFrame:
    """(cid, seed, born): a community keeps the order of birth of its smallest member; new ones come after."""
    seeds = members.groupBy("cid").agg(F.min("id").alias("seed"))
    top = known.agg(F.coalesce(F.max("born"), F.lit(-1)).alias("top"))
    rows = seeds.join(known, "seed", "left")
    fresh = placed(rows.where("born is null").select("cid", "seed"), ["cid"], Scratch(members.sparkSession, "places"))
    fresh = fresh.join(F.broadcast(top)).select("cid", "seed", (F.col("top") + F.col("i") + 1).cast("int").alias("born"))
    return rows.where("born is not null").select("cid", "seed", F.col("born").cast("int").alias("born")).unionByName(fresh)


def project_rollup(nodes: DataFrame, tag: str, aliases: tuple[str, ...] = ()) -> DataFrame:
    """One row for a project under its tag and aliases, each node once: its size, open items, decisions, procedures and
    warnings, maturity classes, the histogram of kinds, and when and what the last thing was that was no tool call."""
    own = active(nodes).where(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in (tag, *aliases)])))
    best = [F.nullif(F.col(c), F.lit("")) for c in ("gist",) if c in nodes.columns]
    said = F.when(F.col("kind") != "tool_call", F.struct("ts", "id", F.coalesce(*best, F.substring("query", 1, 80), F.lit("")).alias("gist")))
    counted = {"open_items": "open_item", "decisions": "decision", "procedures": "procedure", "warnings": "warning"}
    cells = own.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(maturity() == m).alias(m) for m in ("seedling", "budding", "evergreen")], F.max(said).alias("last"))
    return cells.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("nodes"), *[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(c) for c, k in counted.items()],
        *[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in ("seedling", "budding", "evergreen")], F.array_join(F.array_sort(F.collect_list(F.concat("kind", F.lit("="), F.col("n").cast("string")))), ",").alias("kinds"),
        F.max("last")["ts"].alias("last_ts"), F.max("last")["gist"].alias("last_said"),
    )


def not_dismissed(rollup: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Rows that grew, or moved on, since they were dismissed; both have tag, total and last_ts."""
    old = snapshots.select("tag", F.col("total").alias("t0"), F.col("last_ts").alias("l0"))
    rows = rollup.join(old, "tag", "left")
    return rows.where(F.col("t0").isNull() | (F.col("total") > F.col("t0")) | (F.col("last_ts") > F.col("l0"))).drop("t0", "l0")


def since_visit(nodes: DataFrame, marker: Column, cap: int = 99) -> DataFrame:
    """(kind, nodes): what came after a visit's marker; turns count up to a cap."""
    rows = active(nodes).where(F.col("ts") > marker).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("kind", F.when(F.col("kind") == "conversation_turn", F.least("n", F.lit(cap))).otherwise(F.col("n")).alias("nodes"))


def book_week(nodes: DataFrame, as_of: Column, k: int = 12) -> DataFrame:
    rows = active(nodes).where(F.col("kind").isin(*[m for m in MEANING_KINDS if m != "warning"]) & days_between(as_of, F.col("ts")).between(0, 7))
    return rows.orderBy(F.desc("importance"), F.desc("ts"), "id").limit(k)


def topic_members(nodes: DataFrame, cid: str, k: int = 120) -> DataFrame:
    return active(nodes).where(F.substring_index("community", "|", 1) == cid).orderBy(F.desc("importance"), F.desc("ts"), "id").limit(k)


def archived_drawer(nodes: DataFrame, archived: DataFrame) -> DataFrame:
    return not_void(nodes).join(archived.select("id", "archived_at"), "id").orderBy(F.desc("archived_at"), "id")


def doc_cards(nodes: DataFrame) -> DataFrame:
    """(id, path, made): registered documents, with what their tags say."""
    def value(prefix):
        return F.try_element_at(F.filter(F.transform("tags", lambda t: F.when(F.startswith(t, F.lit(prefix)), F.substring(t, F.lit(len(prefix) + 1), F.length(t)))), lambda x: x.isNotNull()), F.lit(1))

    return active(nodes).where("kind = 'artifact'").select("id", value("file:").alias("path"), value("made:").alias("made"))


def router_counts(nodes: DataFrame, as_of: Column) -> DataFrame:
    from .dynamics import pressure

    return active(nodes).agg(
        F.count_if(F.col("kind") == "open_item").alias("open"), F.count_if("flagged").alias("flagged"), F.count_if(F.col("kind") == "idea").alias("ideas"),
        F.count_if(pressure(as_of) >= 6 * F.col("importance")).alias("due"),
    )


def workflow_state(events: DataFrame) -> DataFrame:
    """(node_id, state) from appended events (node_id, action, at): the last of done, undo and parked counts."""
    last = events.groupBy("node_id").agg(F.max_by("action", F.struct("at", "action")).alias("action"))
    return last.select("node_id", F.when(F.col("action") == "undo", "open").otherwise(F.col("action")).alias("state"))


def digest_lines(report: DataFrame) -> DataFrame:
    """(section, place, line): the sections of a session's report that carry over to the next session, cut to their caps."""
    caps = {"decisions": 20, "open items": 15, "hard points": 10, "previous": 8, "insights": 8}
    group = (
        F.when(F.col("section") == "decisions", "decisions").when(F.col("section").isin("open questions", "blockers", "tasks", "resolved"), "open items").when(F.col("section") == "hard points", "hard points")
        .when(F.startswith("section", F.lit("previous")), "previous").when(F.col("section") == "insights", "insights")
    )
    rows = report.withColumn("g", group).where("g is not null")
    place = F.row_number().over(Window.partitionBy("g").orderBy("part", "place"))
    bare = F.regexp_replace(F.regexp_replace("line", r"\s*`[0-9A-Za-z]{1,12}`\s*$", ""), r"^`[0-9A-Za-z]{1,12}`\s*", "")
    return orient_digest(rows.select(F.col("g").alias("section"), place.alias("place"), F.substring(bare, 1, 160).alias("line")), caps)


def orient_digest(sections: DataFrame, caps: dict[str, int]) -> DataFrame:
    """Rows (section, place, line) of a report, cut to each section's cap."""
    cap = F.create_map(*[F.lit(x) for p in caps.items() for x in p])
    return sections.where(F.col("place") <= F.coalesce(cap[F.col("section")], F.lit(8)))


def write_turn(turns: DataFrame, query_cap: int = 2000, preview_cap: int = 8000) -> DataFrame:
    """Turns with capped display fields; the whole text is kept beside them only where the cap cuts it."""
    return turns.select("*", F.substring("text", 1, query_cap).alias("query"), F.substring("text", 1, preview_cap).alias("output_preview"), F.when(F.length("text") > preview_cap, F.col("text")).alias("episodic_full"))


def superseded(nodes: DataFrame, at: Column) -> DataFrame:
    """Changes that void what new nodes replace: targets of supersedes tags, and older cards of the same file."""
    tags = active(nodes).select("id", "kind", "ts", F.explode("tags").alias("tag"))
    named = tags.where("startswith(tag, 'supersedes:')").select(F.substring(F.col("tag"), F.lit(12), F.length("tag")).alias("id"))
    newest = Window.partitionBy("tag").orderBy(F.desc("ts"), F.desc("id"))
    older = tags.where("kind = 'artifact' and startswith(tag, 'file:')").withColumn("r", F.row_number().over(newest)).where("r > 1").select("id")
    return named.union(older).distinct().select("id", F.lit("status").alias("field"), F.lit("void").alias("value"), at.alias("at"))


def embed_pending(nodes: DataFrame, encode, text: Column) -> DataFrame:
    """(id, embedding) for non-void nodes without a vector; `encode` maps a text column's name to a vector column, and
    runs in Arrow batches. Appended as changes, so that facts stay as written."""
    rows = not_void(nodes).where("embedding is null").select("id", text.alias("_text"))
    return rows.select("id", encode("_text").alias("embedding"))


def notify_turns(raw: DataFrame, helper_marks: tuple[str, ...] = ()) -> DataFrame:
    """(session, turn_id, user_text, agent_text) of finished turns from JSON payloads in `value`; calls that a vendor's
    own helpers make, known by marks in their prompt, drop."""
    p = F.from_json("value", "`type` string, `thread-id` string, `turn-id` string, `input-messages` array<string>, `last-assistant-message` string")
    rows = raw.select(p.alias("p")).where("p.`type` = 'agent-turn-complete'")
    user = F.array_join(F.col("p.`input-messages`"), "\n")
    for mark in helper_marks:
        rows = rows.where(~F.contains(F.coalesce(user, F.lit("")), F.lit(mark)))
    return rows.select(F.col("p.`thread-id`").alias("session"), F.col("p.`turn-id`").alias("turn_id"), user.alias("user_text"), F.col("p.`last-assistant-message`").alias("agent_text"))
