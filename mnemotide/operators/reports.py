"""Reports: audit, hub, desk, ideas, registry, accounts; each a frame that a writer can render."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import MEANING_KINDS, active, days_between, not_void
from ..scratch import Scratch
from .dynamics import pressure
from .filters import live


def _finding(rows: DataFrame, check: str, count: Column, least: int, detail: Column | None = None) -> DataFrame:
    one = rows.agg(count.alias("n"), (detail if detail is not None else F.lit(None).cast("string")).alias("detail"))
    return one.where(F.col("n") > least).select(F.lit(check).alias("check"), "n", "detail")


def audit(nodes: DataFrame, ledger: DataFrame, embedded: DataFrame, as_of: Column, projects: dict[str, list[str]], hoard_days: float = 7, hoard_shows: int = 60) -> DataFrame:
    """(check, n, detail): one row for each finding of seven structural checks.

    Open items over 21 days old; over 25 anonymous models in a week; impossible dates; nodes shown over `hoard_shows`
    times in `hoard_days` days (the worst three); meaning nodes without a vector after two days; declared projects without a node; void
    nodes that are still hot or warm.
    """
    n, age = F.count(F.lit(1)), days_between(as_of, F.col("ts"))
    own = ~F.startswith("session", F.lit("import-"))
    stale = active(nodes).where((F.col("kind") == "open_item") & own & (age > 21))
    oldest = F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("ts", "id"))), 1, 3), lambda x: x["id"]), ",")
    oldest_three = stale.orderBy("ts", "id").limit(3)
    names = oldest_three.agg(oldest.alias("detail"))
    found = stale.agg(n.alias("n")).where("n > 0").join(F.broadcast(names)).select(F.lit("stale open items").alias("check"), "n", "detail")
    anonymous = active(nodes).where((age <= 7) & own & F.coalesce("model", F.lit("")).isin("", "unknown", "mcp-client"))
    dates = not_void(nodes).where((age < -1) | (F.col("ts") < F.lit("2020-01-01").cast("timestamp")))
    shown = ledger.where(days_between(as_of, F.col("shown_at")) <= hoard_days).groupBy("node_id").agg(n.alias("shows")).where(F.col("shows") > hoard_shows).orderBy(F.desc("shows"), "node_id").limit(3)
    blind = active(nodes).where(F.col("kind").isin(*MEANING_KINDS) & (age > 2)).join(embedded.select("id"), "id", "left_anti")
    kept = nodes.where("status = 'void' and memory_tier <= 1")
    out = found.unionByName(_finding(anonymous, "anonymous models", n, 25)).unionByName(_finding(dates, "impossible dates", n, 0))
    out = out.unionByName(_finding(shown, "attention hoarding", n, 0, F.max_by("node_id", F.struct("shows", "node_id")))).unionByName(_finding(blind, "unembedded meaning", n, 0))
    out = out.unionByName(_finding(kept, "void but scheduled", n, 0))
    if projects:
        listed = nodes.sparkSession.createDataFrame([(p, t) for p, aliases in projects.items() for t in [p, *aliases]], "project string, tag string")
        used = active(nodes).select(F.explode("tags").alias("tag")).distinct()
        ghosts = listed.join(used.withColumn("hit", F.lit(1)), "tag", "left").groupBy("project").agg(F.count("hit").alias("hits")).where("hits = 0")
        out = out.unionByName(ghosts.select(F.lit("project without nodes").alias("check"), F.lit(0).cast("long").alias("n"), F.col("project").alias("detail")))
    return out


def fresh_findings(findings: DataFrame, last: DataFrame) -> DataFrame:
    """Findings that the last report does not already hold, whatever their date."""
    return findings.join(last.select("check", "n", "detail"), findings["check"].eqNullSafe(last["check"]) & findings["n"].eqNullSafe(last["n"]) & findings["detail"].eqNullSafe(last["detail"]), "left_anti")


def listed(parts: list[tuple[str, DataFrame, list[Column], Column | None]]) -> DataFrame:
    """(section, place, id, note): rows of each part, which are few, numbered in its order; `note` says why or what."""
    out = None
    for name, rows, order, note in parts:
        one = rows.withColumn("place", F.row_number().over(Window.orderBy(*order)))
        one = one.select(F.lit(name).alias("section"), "place", "id", (F.lit(None) if note is None else note).cast("string").alias("note"))
        out = one if out is None else out.unionByName(one)
    return out


# Kinds that count as news, besides those with meaning.
NEWS_KINDS = (*MEANING_KINDS, "conversation_turn", "artifact")


def hub(nodes: DataFrame, ledger: DataFrame, hidden: DataFrame, as_of: Column, rooms: str = "room:") -> DataFrame:
    """(section, place, id, note): open items (8), fading (5, with times shown), ideas (6), a week's activity by session
    and model (10), the number of a week's chat nodes, dated nodes overdue, of today and next (5), and news (10).

    Limits come before hiding, as the lists are cut before a person's choices apply; only dated ones are hidden first.
    """
    from . import rollups
    from .dynamics import fading

    rows, gone = active(nodes), hidden.select("id")
    newest = [F.desc("ts"), F.col("id")]

    def top(part: DataFrame, k: int) -> DataFrame:
        return part.orderBy(*newest).limit(k).join(gone, "id", "left_anti")

    week = days_between(as_of, F.col("ts")) <= 7
    faded = fading(nodes, ledger, as_of).join(gone, "id", "left_anti")
    moved = rollups.activity(nodes.where(~F.startswith("session", F.lit("import-"))), as_of)
    chat = rows.where(week & F.startswith("session", F.lit(rooms))).agg(F.count(F.lit(1)).cast("string").alias("id"))
    dated = due_split(nodes, F.to_date(as_of)).join(gone, "id", "left_anti")
    by_due = [F.col("due"), F.col("id")]
    return listed([
        ("open", top(rows.where("kind = 'open_item'"), 8), newest, None), ("fading", faded, [F.desc("importance"), F.desc("neglect"), F.desc("unseen"), F.col("id")], F.col("unseen")), ("ideas", top(rows.where("kind = 'idea'"), 6), newest, None),
        ("activity", moved.withColumnRenamed("session", "id"), [F.desc("nodes"), F.col("id"), F.col("model")], F.concat_ws(" ", "model", "nodes")), ("chat", chat, [F.col("id")], None),
        ("overdue", dated.where("state = 'overdue'"), by_due, F.col("due")), ("today", dated.where("state = 'today'"), by_due, F.col("due")), ("upcoming", dated.where("state = 'upcoming'").orderBy(*by_due).limit(5), by_due, F.col("due")),
        ("news", top(rows.where(F.col("kind").isin(*NEWS_KINDS) & ~F.startswith("session", F.lit("import-"))), 10), newest, F.col("kind")),
    ])


def due_split(nodes: DataFrame, today: Column) -> DataFrame:
    """(id, due, state): dated nodes, overdue, due today or upcoming."""
    from ..functions.text import due_date

    rows = active(nodes).select("id", F.to_date(due_date(F.col("tags"))).alias("due")).where("due is not null")
    return rows.select("id", "due", F.when(F.col("due") < today, "overdue").when(F.col("due") == today, "today").otherwise("upcoming").alias("state"))


def answered(nodes: DataFrame, pattern: str = r"\b[0-9a-f]{12}\b") -> DataFrame:
    """(id): nodes that the text of a resolution names."""
    text = F.concat_ws(" ", *[c for c in ("query", "output_preview") if c in nodes.columns])
    return active(nodes).where("kind = 'resolved'").select(F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("id")).distinct()


def desk_lanes(nodes: DataFrame, hidden: DataFrame, done: DataFrame) -> DataFrame:
    """(id, lane, due, importance, ts): open loops (60, by importance and age) and watched nodes (30, newest), which come in
    two lists so that neither crowds out the other; each id once, without what is hidden or answered.

    Items and blockers with a due date, and questions with one, are dated; without, items and blockers are open, and
    questions are no work. All else is watched. Limits come before hiding.
    """
    from ..functions.text import due_date

    rows = live(active(nodes))
    loops = rows.where(F.col("kind").isin("open_item", "blocker", "question")).orderBy(F.desc("importance"), "ts", "id").limit(60)
    watch = rows.where("kind = 'warning' or flagged").orderBy(F.desc("ts"), "id").limit(30)
    cols = ["id", "kind", "importance", "ts", due_date(F.col("tags")).alias("due")]
    both = loops.select(*cols).unionByName(watch.select(*cols)).dropDuplicates(["id"])
    both = both.join(hidden.select("id"), "id", "left_anti").join(done.select("id"), "id", "left_anti")
    work, dated = F.col("kind").isin("open_item", "blocker"), F.col("due").isNotNull()
    lane = F.when(work & dated, "dated").when(work, "open").when((F.col("kind") == "question") & dated, "dated").when(F.col("kind") == "question", None).otherwise("watch")
    return both.withColumn("lane", lane).where("lane is not null").select("id", "lane", "due", "importance", "ts")


def tend(nodes: DataFrame, ledger: DataFrame, as_of: Column, without: DataFrame, k: int = 12) -> DataFrame:
    """(id, reasons, place): what is being forgotten, by the number of reasons, importance, and who found it first.

    Four searches, each cut by itself: overdue review (12 meaning nodes that are not cold, after three days), fading (8,
    shown twice and never cited), loose threads (8 questions and hypotheses without children, oldest first) and the deep
    (6 important insights, decisions and hypotheses, after three days). Ids in `without` are elsewhere already.
    """
    from .dynamics import fading

    rows = live(active(nodes)).withColumn("due", pressure(as_of))
    old = days_between(as_of, F.col("ts")) >= 3
    pressed = [F.desc("due"), F.col("id")]
    kids = active(nodes).where("parent is not null").select(F.col("parent").alias("id")).distinct()
    loose = rows.where(F.col("kind").isin("question", "hypothesis")).join(kids, "id", "left_anti")
    found = [
        ("overdue review", rows.where(F.col("kind").isin(*MEANING_KINDS) & (F.col("memory_tier") <= 1) & old).orderBy(*pressed).limit(12), pressed),
        ("fading", fading(live(nodes), ledger, as_of, k=8), [F.desc("importance"), F.desc("neglect"), F.desc("unseen"), F.col("id")]),
        ("loose thread", loose.orderBy("ts", "id").limit(8), [F.col("ts"), F.col("id")]),
        ("from the deep", rows.where(F.col("kind").isin("insight", "decision", "hypothesis") & (F.col("importance") >= 6) & old).orderBy(*pressed).limit(6), pressed),
    ]
    every = None
    for o, (reason, part, order) in enumerate(found):
        one = part.select("id", "importance", F.struct(F.lit(o).alias("o"), F.row_number().over(Window.orderBy(*order)).alias("r"), F.lit(reason).alias("reason")).alias("r"))
        every = one if every is None else every.unionByName(one)
    every = every.join(without.select("id"), "id", "left_anti")
    out = every.groupBy("id").agg(F.max("importance").alias("importance"), F.array_sort(F.collect_list("r")).alias("rs"))
    order = [F.desc(F.size("rs")), F.desc("importance"), F.element_at("rs", 1)["o"], F.element_at("rs", 1)["r"]]
    rows = out.orderBy(*order).limit(k).withColumn("place", F.row_number().over(Window.orderBy(*order)))
    return rows.select("id", F.array_join(F.transform("rs", lambda x: x["reason"]), ",").alias("reasons"), "place")


def desk(nodes: DataFrame, ledger: DataFrame, hidden: DataFrame, findings: DataFrame, as_of: Column, pattern: str = r"\b[0-9a-f]{12}\b") -> DataFrame:
    """(section, place, id, note): dated work by date, open work, what to tend with its reasons, watched nodes (8, newest),
    the inbox (30), and problems: an audit's `findings` (check, n) and the number of flagged nodes."""
    done = answered(nodes, pattern)
    lanes = Scratch(nodes.sparkSession, "desk").save(desk_lanes(nodes, hidden, done))
    newest = [F.desc("ts"), F.col("id")]
    watch = lanes.where("lane = 'watch'").orderBy(*newest).limit(8)
    inbox = active(nodes).where(F.array_contains("tags", "inbox")).orderBy(*newest).limit(30).join(hidden.select("id"), "id", "left_anti")
    shown = lanes.where("lane <> 'watch'").select("id").union(watch.select("id")).union(inbox.select("id")).union(hidden.select("id")).union(done.select("id")).distinct()
    flagged = active(nodes).where("flagged").agg(F.lit("flagged").alias("check"), F.count(F.lit(1)).alias("n"))
    problems = findings.select("check", "n").unionByName(flagged).withColumnRenamed("check", "id")
    return listed([
        ("dated", lanes.where("lane = 'dated'"), [F.col("due"), F.col("id")], F.col("due")), ("open", lanes.where("lane = 'open'"), [F.desc("importance"), F.col("ts"), F.col("id")], None),
        ("tend", tend(nodes, ledger, as_of, shown).withColumnRenamed("place", "p"), [F.col("p")], F.col("reasons")), ("watch", watch, newest, None), ("inbox", inbox, newest, None), ("problems", problems, [F.col("id")], F.col("n")),
    ])


def ideas(nodes: DataFrame, hidden: DataFrame, as_of: Column) -> DataFrame:
    """(section, place, id, findings, ripe): ideas (100, newest) that are fresh for 14 days and then banked, other nodes that
    were parked (20), and the queue of research asked for (20). Findings are active children; an idea is ripe with a
    stability of two days and a finding."""
    rows, newest, gone = active(nodes), [F.desc("ts"), F.col("id")], hidden.select("id")
    found = rows.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("findings"))
    own = rows.where("kind = 'idea'").orderBy(*newest).limit(100).withColumn("section", F.when(days_between(as_of, F.col("ts")) <= 14, "fresh").otherwise("bank"))
    parked = rows.where((F.col("kind") != "idea") & F.array_contains("tags", "parked")).orderBy(*newest).limit(20).withColumn("section", F.lit("parked"))
    queue = rows.where((F.col("kind") == "open_item") & F.array_contains("tags", "research-queue")).orderBy(*newest).limit(20).withColumn("section", F.lit("queue"))
    every = own.unionByName(parked).unionByName(queue).join(gone, "id", "left_anti").join(found, "id", "left").withColumn("findings", F.coalesce("findings", F.lit(0)))
    ripe = F.when(F.col("section").isin("fresh", "bank"), (F.col("stability_days") >= 2) & (F.col("findings") >= 1))
    return every.withColumn("place", F.row_number().over(Window.partitionBy("section").orderBy(*newest))).select("section", "place", "id", "findings", ripe.alias("ripe"))


def flagged(nodes: DataFrame, hidden: DataFrame, k: int = 100) -> DataFrame:
    """Flagged nodes, newest first; hidden ones leave after the cut."""
    return active(nodes).where("flagged").orderBy(F.desc("ts"), "id").limit(k).join(hidden.select("id"), "id", "left_anti")


def project_detail(nodes: DataFrame, tags: list[str], pool: int = 200) -> DataFrame:
    """(section, place, id, note): a project's sections over its newest nodes, and one row of totals.

    Attention (12: open items, warnings, blockers, flagged), decisions, procedures, knowledge and recent (10 each); the
    note of `stats` has nodes, sessions and both ends of all of its nodes.
    """
    own = active(nodes).where(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])))
    newest = [F.desc("ts"), F.col("id")]
    rows = Scratch(nodes.sparkSession, "project").save(own.orderBy(*newest).limit(pool).select("id", "kind", "flagged", "ts"))
    kind = F.col("kind")
    wanted = [("attention", kind.isin("open_item", "warning", "blocker") | F.col("flagged"), 12), ("decisions", kind == "decision", 10), ("procedures", kind == "procedure", 10), ("knowledge", kind.isin("insight", "hypothesis"), 10), ("recent", ~kind.isin("tool_call", "interrupt"), 10)]
    day = "yyyy-MM-dd HH:mm:ss"
    stats = own.agg(F.lit("stats").alias("id"), F.concat_ws(" ", F.count(F.lit(1)).cast("string"), F.countDistinct("session").cast("string"), F.date_format(F.min("ts"), day), F.date_format(F.max("ts"), day)).alias("note"))
    return listed([*[(name, rows.where(fits).orderBy(*newest).limit(k), newest, None) for name, fits, k in wanted], ("stats", stats, [F.col("id")], F.col("note"))])


def index(nodes: DataFrame, hidden: DataFrame, k: int = 200) -> DataFrame:
    """(section, place, label, note): the index from A to Z: tags with counts, documents with paths, terms with definitions,
    topics with counts, and consolidated knowledge (newest `k`, hidden ones left out) under its largest merge."""
    from . import rollups
    from .views import doc_cards

    title = F.substring(F.col("query"), F.lit(6), F.length("query"))
    docs = active(nodes).where("kind = 'artifact'").select("id", "query", title.alias("label")).join(doc_cards(nodes), "id")
    terms = active(nodes).where("kind = 'term'").select("id", "query", F.substring_index("query", ":", 1).alias("label"), F.trim(F.when(F.contains("query", F.lit(":")), F.substring(F.col("query"), F.instr("query", F.lit(":")) + 1, F.length("query"))).otherwise("")).alias("note"))
    grown = active(nodes).where(F.col("kind").isin("insight", "procedure") & F.exists("tags", lambda t: F.contains(t, F.lit("consolidated")))).orderBy(F.desc("ts"), "id").limit(k).join(hidden.select("id"), "id", "left_anti")
    parts = [
        ("tags", rollups.tag_index(nodes).select(F.col("tag").alias("label"), F.col("nodes").cast("string").alias("note"), F.lower("tag").alias("o1"), F.col("tag").alias("o2"))), ("docs", docs.select("label", F.col("path").alias("note"), F.col("query").alias("o1"), F.col("id").alias("o2"))),
        ("terms", terms.select("label", "note", F.col("query").alias("o1"), F.col("id").alias("o2"))), ("topics", rollups.topics(nodes).select("label", F.col("total").cast("string").alias("note"), F.lpad((F.lit(10**15) - F.col("total")).cast("string"), 16, "0").alias("o1"), F.col("cid").alias("o2"))),
        ("consolidated", grown.select(consolidated_label(F.col("query")).alias("label"), F.col("id").alias("note"), F.lpad((F.lit(10**17) - F.unix_micros("ts")).cast("string"), 18, "0").alias("o1"), F.col("id").alias("o2"))),
    ]
    out = None
    for name, rows in parts:
        one = rows.withColumn("place", F.row_number().over(Window.orderBy("o1", "o2"))).select(F.lit(name).alias("section"), "place", "label", "note")
        out = one if out is None else out.unionByName(one)
    return out


REGISTRY_ROW = "slug string, name string, status string, aliases array<string>, evidence int, why string, proposed_at string, last_action struct<action: string, reason: string, by: string>"
# The order of states in the report, and the state that follows an action.
STATUS_RANK = {"blessed": 0, "proposed": 1, "revived": 2, "archived": 3, "passed": 4}
NEXT_STATUS = {"bless": "blessed", "pass": "passed", "archive": "archived", "revive": "revived"}


def registry_fold(nodes: DataFrame) -> DataFrame:
    """The newest state of every registry row: JSON in the text of nodes with the registry tag, newest first by slug."""
    blob = F.from_json(F.regexp_extract("query", r"(?s)(\{.*\})", 1), REGISTRY_ROW)
    rows = active(nodes).where(F.array_contains("tags", "registry-row")).select("ts", "id", blob.alias("r")).where("r.slug is not null")
    return rows.groupBy("r.slug").agg(F.max_by(F.struct("r", "ts"), F.struct("ts", "id")).alias("last")).select("last.r.*", "last.ts")


def registry_propose(registry: DataFrame, proposals: DataFrame, declared: list[str], at: Column) -> DataFrame:
    """(slug, line, state): new rows for proposals (name, aliases, evidence, why) whose slug has no row and is no declared
    project. A slug that is proposed twice takes the proposal with the most evidence."""
    key = F.substring(F.btrim(F.regexp_replace(F.lower(F.coalesce("name", F.lit(""))), "[^a-z0-9]+", "-"), F.lit("-")), 1, 48)
    rows = proposals.withColumn("slug", key).where((F.col("slug") != "") & ~F.col("slug").isin(*(declared or [""]))).join(registry.select("slug"), "slug", "left_anti")
    one = rows.groupBy("slug").agg(F.max_by(F.struct("name", "aliases", "evidence", "why"), F.struct("evidence", "name")).alias("p")).select("slug", "p.*")
    named = F.slice(F.coalesce("aliases", F.array().cast("array<string>")), 1, 40)
    state = F.to_json(F.struct("slug", "name", F.lit("proposed").alias("status"), named.alias("aliases"), "evidence", F.substring(F.coalesce("why", F.lit("")), 1, 300).alias("why"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss").alias("proposed_at")))
    line = F.concat(F.lit("REGISTRY "), "slug", F.lit(" — proposed — "), "name", F.lit(" ("), F.col("evidence").cast("string"), F.lit(" notes) — "), F.substring(F.coalesce("why", F.lit("")), 1, 120))
    return one.select("slug", F.substring(line, 1, 500).alias("line"), state.alias("state"))


def registry_act(registry: DataFrame, actions: DataFrame) -> DataFrame:
    """(slug, line, state): the state after each action (slug, action, reason, by, at); of several on a slug the last counts.
    Unknown slugs and actions write nothing, and nothing is ever deleted."""
    following = F.create_map(*[F.lit(x) for pair in NEXT_STATUS.items() for x in pair])
    last = actions.where(F.col("action").isin(*NEXT_STATUS)).groupBy("slug").agg(F.max_by(F.struct("action", "reason", "by"), F.struct("at", "action")).alias("a"))
    rows = registry.join(last, "slug").withColumn("status", following[F.col("a.action")])
    reason = F.coalesce("a.reason", F.lit(""))
    state = F.to_json(F.struct("slug", "name", "status", "aliases", "evidence", "why", "proposed_at", F.struct(F.col("a.action"), F.substring(reason, 1, 200).alias("reason"), F.col("a.by")).alias("last_action")))
    line = F.concat(F.lit("REGISTRY "), "slug", F.lit(" — "), "status", F.lit(" by "), F.col("a.by"), F.when(reason != "", F.concat(F.lit(" — "), F.substring(reason, 1, 120))).otherwise(""))
    return rows.select("slug", F.substring(line, 1, 500).alias("line"), state.alias("state"))


def registry_nodes(written: DataFrame, at: Column) -> DataFrame:
    """Written registry rows as nodes to append."""
    return written.select(
        F.substring(F.sha2(F.concat_ws("|", "slug", "state"), 256), 1, 12).alias("id"), F.lit("registry").alias("session"), F.lit("decision").alias("kind"), F.concat("line", F.lit("\n"), "state").alias("query"),
        F.lit("active").alias("status"), F.array(F.lit("registry"), F.lit("registry-row"), F.concat(F.lit("proj:"), "slug")).alias("tags"), at.alias("ts"),
    )


def finish_lines(registry: DataFrame) -> DataFrame:
    rank = F.create_map(*[F.lit(x) for p in STATUS_RANK.items() for x in p])
    return registry.orderBy(F.coalesce(rank[F.col("status")], F.lit(9)), F.desc("evidence"), "slug")


def dormant_projects(nodes: DataFrame, tags: list[str], as_of: Column, days: float = 7) -> DataFrame:
    rows = active(nodes).select("ts", F.explode("tags").alias("tag")).where(F.col("tag").isin(*tags)).groupBy("tag").agg(F.max("ts").alias("last_ts"))
    return rows.where(days_between(as_of, F.col("last_ts")) >= days)


def account_doctor(sessions: DataFrame, proof: DataFrame, provable: str = "^[0-9a-fA-F-]{36}$") -> DataFrame:
    """(class, sessions): stored accounts against proof (id, slug).

    Sessions whose id has the `provable` shape are covered or uncovered by proof, and covered ones agree with it or are
    a mismatch; locked ones count besides. All others are unprovable, which says nothing against them.
    """
    rows = sessions.where("account is not null").join(proof.select("id", "slug"), "id", "left")
    known = F.col("slug").isNotNull()
    labels = F.when(~F.rlike("id", F.lit(provable)), F.array(F.lit("unprovable"))).otherwise(
        F.array_compact(F.array(F.when(known, "covered").otherwise("uncovered"), F.when(known, F.when(F.lower("slug") == F.lower("account"), "agree").otherwise("mismatch")), F.when(F.col("account_locked"), "locked")))
    )
    return rows.select(F.explode(labels).alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("sessions"))


def account_backfill(sessions: DataFrame, proof: DataFrame, canary: list[str]) -> DataFrame:
    """(class, sessions): how a repair of accounts would treat every session."""
    rows = sessions.join(proof.select("id", "slug"), "id", "left")
    label = (
        F.when(F.startswith("id", F.lit("import-")), "imports").when(F.col("id").isin(*canary), "canary").when(F.col("slug").isNull(), "leave")
        .when(F.coalesce(F.lower("slug") == F.lower("account"), F.lit(False)), "agree").otherwise("repair")
    )
    return rows.groupBy(label.alias("class")).agg(F.count(F.lit(1)).alias("sessions"))


def definitions(nodes: DataFrame) -> DataFrame:
    """(term, id): `term: definition` openings of insights and decisions."""
    term = F.regexp_extract("query", r"^([A-Za-z][A-Za-z0-9 _-]{1,40}): \S", 1)
    return active(nodes).where(F.col("kind").isin("insight", "decision")).select(F.lower(term).alias("term"), "id").where("term <> ''")


def consolidated_label(text: Column) -> Column:
    """Stacked `[consolidated xN ...]` openings as one, with the largest N."""
    counts = F.transform(F.regexp_extract_all(text, F.lit(r"\[consolidated x(\d+)[^\]]*\]"), F.lit(1)), lambda n: n.cast("int"))
    rest = F.ltrim(F.regexp_replace(text, r"\[consolidated x\d+[^\]]*\]\s*", ""))
    return F.when(F.size(counts) > 0, F.concat(F.lit("[consolidated x"), F.array_max(counts).cast("string"), F.lit("] "), rest)).otherwise(text)
