"""How memories age: due pressure, exposure, schedules, tiers, consolidation and lessons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import duplicate_keywords
from ..functions.similarity import similar_roots
from ..model import CONSOLIDATION_KINDS, HEARTBEAT_KINDS, METHOD_KINDS, SLOW_MS, active, days_between, not_void
from ..scratch import Scratch
from .components import connected_components
from .containment import next_matching
from .graph import PHI_INV_SQ
from .scans import running

#: Similarity graphs with no more edges than these have their components found in one task.
LOCAL_EDGES = 250_000


def pressure(as_of: Column) -> Column:
    """Days since the last exposure over stability, times importance; never exposed counts from 2020."""
    last = F.coalesce("last_injected", F.lit("2020-01-01").cast("timestamp"))
    return days_between(as_of, last) / F.greatest("stability_days", F.lit(0.1)) * F.col("importance")


def shows(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy(F.col("node_id").alias("id")).agg(F.count(F.lit(1)).alias("shows"))


def heartbeat(nodes: DataFrame, ledger: DataFrame, as_of: Column, k: int = 9) -> DataFrame:
    """The k most due memories; much shown ones weigh less, hot ones double. The ledger is aggregated before the join."""
    rows = active(nodes).where(F.col("kind").isin(*HEARTBEAT_KINDS)).join(shows(ledger), "id", "left")
    due = pressure(as_of) / (1 + F.coalesce("shows", F.lit(0)) / 25.0) * F.when(F.col("memory_tier") == 0, 2.0).otherwise(1.0)
    return rows.withColumn("due", due).orderBy(F.desc("due"), "id").limit(k)


def review_queue(nodes: DataFrame, as_of: Column, kinds: tuple[str, ...], k: int = 12) -> DataFrame:
    return active(nodes).where(F.col("kind").isin(*kinds)).withColumn("due", pressure(as_of)).orderBy(F.desc("due"), "id").limit(k)


def fading(nodes: DataFrame, ledger: DataFrame, as_of: Column, least: int = 2, k: int = 5) -> DataFrame:
    """Shown at least twice and never cited: important and long neglected first."""
    unseen = ledger.where(~F.col("cited")).groupBy(F.col("node_id").alias("id")).agg(F.count(F.lit(1)).alias("unseen")).where(F.col("unseen") >= least)
    rows = active(nodes).join(unseen, "id").withColumn("neglect", pressure(as_of) / F.col("importance"))
    return rows.orderBy(F.desc("importance"), F.desc("neglect"), F.desc("unseen"), "id").limit(k)


def mark_cited(ledger: DataFrame, cited_ids: DataFrame) -> DataFrame:
    """The ledger with every receipt of the given nodes cited."""
    hit = cited_ids.select(F.col("id").alias("node_id"), F.lit(True).alias("_now")).distinct()
    return ledger.join(hit, "node_id", "left").withColumn("cited", F.col("cited") | F.coalesce("_now", F.lit(False))).drop("_now")


def record_shown(ids: DataFrame, session: str, channel: str, trigger: str, at: Column) -> DataFrame:
    """Receipts for an array column `ids`: one row for each place."""
    return ids.select(F.posexplode("ids").alias("position", "node_id")).select("node_id", F.lit(session).alias("session"), F.lit(channel).alias("channel"), "position", F.lit(trigger).alias("trigger"), at.alias("shown_at"), F.lit(False).alias("cited"))


def _change(rows: DataFrame, field: str, value: Column, at: Column) -> DataFrame:
    return rows.select("id", F.lit(field).alias("field"), value.cast("string").alias("value"), at.alias("at"))


def exposures(receipts: DataFrame) -> DataFrame:
    """Changes that stamp every shown node with the time of its last showing, for `fold_changes`."""
    last = receipts.groupBy(F.col("node_id").alias("id")).agg(F.max("shown_at").alias("at"))
    return _change(last, "last_injected", F.col("at"), F.col("at"))


# How stability grows when a memory proves its use, in days up to a year.
GROWTH, YEAR = {"member": 1.3, "proxy": 1.3, "report": 1.6, "review": 1.2}, 365.0


def grown(nodes: DataFrame, proven: DataFrame, at: Column) -> DataFrame:
    """Changes to the stability of nodes that were recalled: `proven` has id and why, a key of `GROWTH`.

    Several proofs of one kind count once; those of different kinds multiply. Void nodes do not grow.
    """
    factor = F.create_map(*[F.lit(x) for pair in GROWTH.items() for x in pair])
    by = proven.select("id", "why").distinct().groupBy("id").agg(F.product(factor[F.col("why")]).alias("f"))
    rows = not_void(nodes).join(by, "id")
    return _change(rows, "stability_days", F.least(F.lit(YEAR), F.coalesce(F.nullif("stability_days", F.lit(0.0)), F.lit(1.0)) * F.col("f")), at)


def cited_in(nodes: DataFrame, reports: DataFrame) -> DataFrame:
    """(id, why): active nodes of a session, and hot ones of any, that the text of a session's report names by id.

    `reports` has session and text. Names are taken from the texts, so a report meets the nodes it names and no others.
    """
    named = reports.select("session", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[0-9A-Za-z_]+"), F.lit(0)))).alias("id")).distinct()
    rows = active(nodes).select("id", F.col("session").alias("own"), "memory_tier").join(named, "id").where("own = session or memory_tier = 0")
    return rows.select("id", F.lit("report").alias("why")).distinct()


def absorbed_members(members: DataFrame, nodes: DataFrame, at: Column) -> DataFrame:
    """Changes to the members (id) of new consolidated nodes: more stable, stamped as of now, and warm ones become cold."""
    ids = members.select("id").distinct()
    rows = not_void(nodes).join(ids, "id", "left_semi")
    changes = grown(nodes, ids.withColumn("why", F.lit("member")), at).unionByName(_change(rows, "last_injected", at, at))
    return changes.unionByName(_change(rows.where("memory_tier = 1"), "memory_tier", F.lit(2), at))


def tier_steps(nodes: DataFrame, steps: DataFrame, at: Column) -> DataFrame:
    """Changes of tiers by `steps` (id, step): -1 is one tier hotter, 1 one colder, within 0 and 2; none where none moves."""
    rows = nodes.join(steps.groupBy("id").agg(F.sum("step").alias("step")), "id")
    to = F.greatest(F.lit(0), F.least(F.lit(2), F.col("memory_tier") + F.col("step")))
    return _change(rows.where(to != F.col("memory_tier")), "memory_tier", to, at)


def warm_limit(context_tokens: int = 200_000) -> int:
    """How many warm blocks a session may be sent: 40 for a window of 200,000 tokens, in proportion."""
    return -(-40 * context_tokens // 200_000)


def warm_sent(ledger: DataFrame, nodes: DataFrame, verbatim: int = 3) -> DataFrame:
    """(session, sent): warm blocks that heartbeats sent to each session, gists as thirds. It comes from the receipts of
    the session itself, so a new session begins with nothing spent."""
    beats = ledger.where("channel = 'heartbeat'").join(nodes.where("memory_tier = 1").select(F.col("id").alias("node_id")), "node_id", "left_semi")
    return beats.groupBy("session").agg(F.sum(F.when(F.col("position") < verbatim, 1.0).otherwise(1 / 3.0)).alias("sent"))


def heartbeat_packs(fired: DataFrame, nodes: DataFrame, ledger: DataFrame, as_of: Column, verbatim: int = 3, gists: int = 6, context_tokens: int = 200_000) -> DataFrame:
    """(session, place, id, form): what a heartbeat shows each session in `fired`: the most due memories of other sessions,
    the first `verbatim` in full and the next `gists` as gists. A session over its warm limit gets hot ones only.

    Any session's pack lies within the first 2k (k = verbatim + gists) of the list that holds the k most due of each
    session, as leaving out its own takes k of them at most. So all sessions meet one short list, made once for warm and
    once for hot alone.
    """
    k = verbatim + gists
    due = pressure(as_of) / (1 + F.coalesce("shows", F.lit(0)) / 25.0) * F.when(F.col("memory_tier") == 0, 2.0).otherwise(1.0)
    rows = active(nodes).where(F.col("kind").isin(*HEARTBEAT_KINDS) & (F.col("memory_tier") <= 1)).join(shows(ledger), "id", "left").select("id", F.col("session").alias("own"), "memory_tier", due.alias("due"))
    order = [F.desc("due"), F.col("id")]
    lists = None
    for gate, part in ((False, rows), (True, rows.where("memory_tier = 0"))):
        near = part.withColumn("r", F.row_number().over(Window.partitionBy("own").orderBy(*order))).where(F.col("r") <= k)
        one = near.orderBy(*order).limit(2 * k).withColumn("hot_only", F.lit(gate))
        lists = one if lists is None else lists.unionByName(one)
    over = F.coalesce("sent", F.lit(0.0)) >= warm_limit(context_tokens)
    asked = fired.select("session").distinct().join(warm_sent(ledger, nodes, verbatim), "session", "left").select("session", over.alias("hot_only"))
    met = asked.join(F.broadcast(lists), "hot_only").where("own <> session")
    place = F.row_number().over(Window.partitionBy("session").orderBy(*order)) - 1
    met = met.withColumn("place", place).where(F.col("place") < k)
    return met.select("session", "place", "id", F.when(F.col("place") < verbatim, "verbatim").otherwise("gist").alias("form"))


def hot_lease(nodes: DataFrame, ledger: DataFrame, as_of: Column, most_shows: int = 150, days: float = 14) -> DataFrame:
    """Hot, unflagged nodes that are old and were shown too often: they become warm."""
    worn = shows(ledger).where(F.col("shows") > most_shows)
    return active(nodes).where("memory_tier = 0 and not flagged").where(days_between(as_of, F.col("ts")) > days).join(worn, "id").select("id", "shows", F.lit(1).alias("memory_tier"))


def cold_demotion(nodes: DataFrame, sessions: DataFrame, current: str, referenced: DataFrame | None = None, newest: int = 3) -> DataFrame:
    """Warm active nodes outside the current and the newest sessions that nothing refers to: they become cold."""
    recent = sessions.orderBy(F.desc("started_at"), "id").limit(newest).select(F.col("id").alias("session"))
    rows = active(nodes).where((F.col("memory_tier") == 1) & (F.col("session") != current)).join(F.broadcast(recent), "session", "left_anti")
    if referenced is not None:
        rows = rows.join(referenced.select("id"), "id", "left_anti")
    return rows.select("id", "session", F.lit(2).alias("memory_tier"))


def golden_position(index: Column) -> Column:
    """Places in [0, 1) that spread evenly at any count."""
    return F.pmod(index * F.lit(PHI_INV_SQ), F.lit(1.0))


def underattended() -> Column:
    return (F.coalesce("middle_hits", F.lit(0)) >= 2) & (F.coalesce("compiled_hits", F.lit(0)) == 0) & (F.coalesce("total_loads", F.lit(0)) >= 2)


def schedule_context(nodes: DataFrame, positions: DataFrame, order: list[Column], most: int = 40) -> DataFrame:
    """(id, section, place, in_middle) for the nodes of one session: core first, then neglected ones, then the rest by
    golden position, and the three newest last. A session is one window, which its working set bounds."""
    rows = nodes.join(positions.withColumnRenamed("node_id", "id"), "id", "left")
    rows = rows.withColumn("section", F.when(F.col("status") == "core", 0).when(underattended(), 1).otherwise(2)).withColumn("_o", F.row_number().over(Window.orderBy(*order)))
    newest = Window.partitionBy("section").orderBy(F.desc("ts"), "_o")
    rows = rows.withColumn("_n", F.row_number().over(newest)).withColumn("section", F.when((F.col("section") == 2) & (F.col("_n") <= 3), 3).otherwise(F.col("section")))
    within = F.row_number().over(Window.partitionBy("section").orderBy("_o")) - 1
    key = F.when(F.col("section") == 2, golden_position(within)).when(F.col("section") == 3, F.col("_n").cast("double")).otherwise(F.col("_o").cast("double"))
    rows = rows.withColumn("_k", key).withColumn("place", F.row_number().over(Window.orderBy("section", "_k", "_o")) - 1).where(F.col("place") < most)
    total = F.count(F.lit(1)).over(Window.partitionBy())
    middle = (F.col("place") >= F.floor(total / 3)) & (F.col("place") < F.floor(2 * total / 3))
    return rows.select("id", "section", "place", middle.alias("in_middle"))


def manifest(nodes: DataFrame, window_tokens: int = 200_000, scratch: Scratch | None = None) -> DataFrame:
    """(session, id, memory_tier, position, band): hot nodes at 0, warm ones at golden places of the window; for every
    session at once."""
    kept = not_void(nodes).where("memory_tier <= 1")
    rows = running(kept, ["session", "memory_tier"], ["ts", "seq"], scratch or Scratch(nodes.sparkSession, "manifest"), sums={"place": F.lit(1)}, before=True)
    place = F.when(F.col("memory_tier") == 0, F.lit(0)).otherwise(F.floor(golden_position(F.col("place")) * window_tokens)).cast("int")
    return rows.select("session", "id", "memory_tier", place.alias("position")).withColumn("band", F.floor(F.col("position") / 10_000).cast("int"))


def schedule_summary(nodes: DataFrame, window_tokens: int = 200_000) -> DataFrame:
    """(session, hot, warm, cold, window, coverage): what the manifest of each session places, what it leaves to retrieval
    (active cold nodes), and the placed share in whole percent, half to even. The product comes before the quotient, as shares like 23 of 40 are no
    binary fractions and times a hundred fall below a half."""
    cold = (F.col("memory_tier") == 2) & (F.col("status") == "active")
    hot, warm = (F.count_if((F.col("memory_tier") == t) & (F.col("status") != "void")) for t in (0, 1))
    rows = nodes.groupBy("session").agg(hot.alias("hot"), warm.alias("warm"), F.count_if(cold).alias("cold"))
    placed = F.col("hot") + F.col("warm")
    share = F.bround(placed * 100.0 / F.greatest(F.lit(1), placed + F.col("cold")), 0).cast("int")
    return rows.select("session", "hot", "warm", "cold", F.lit(window_tokens).alias("window"), F.concat(share.cast("string"), F.lit("%")).alias("coverage"))


def position_feedback(loads: DataFrame, order: list[str], compiled: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node_id, loads, middle, hits) from rows (session, node_id) and (session, report): places within each session's
    load order, and whether the report names the node."""
    placed = running(loads.select("session", "node_id", *order), ["session"], [*order, "node_id"], scratch or Scratch(loads.sparkSession, "feedback"), sums={"at": F.lit(1)}, before=True)
    sessions = loads.groupBy("session").agg(F.count(F.lit(1)).alias("n")).join(compiled, "session", "left")
    middle = (F.col("at") >= F.floor(F.col("n") / 3)) & (F.col("at") < F.floor(2 * F.col("n") / 3))
    rows = placed.join(sessions, "session")
    return rows.groupBy("node_id").agg(F.count(F.lit(1)).alias("loads"), F.count_if(middle).alias("middle"), F.count_if(F.contains("report", F.col("node_id"))).alias("hits"))


def gini(df: DataFrame, value: str) -> DataFrame:
    """One row: how unevenly the values are spread, 0 to 1. Ranks come from counts of equal values, so no global sort
    of all rows is needed: ties have the mean of their ranks, which leaves the sum as it is."""
    by = df.groupBy(F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.orderBy("v"))
    ranked = by.select("v", "c", (upto - (F.col("c") - 1) / 2.0).alias("r"))
    n, total = F.sum("c"), F.sum(F.col("v") * F.col("c"))
    return ranked.agg(F.when(total > 0, 2 * F.sum(F.col("r") * F.col("v") * F.col("c")) / (n * total) - (n + 1) / n).otherwise(0.0).alias("gini"))


def absorbed(nodes: DataFrame) -> DataFrame:
    """Ids that an active consolidated insight or procedure already stands for."""
    rows = active(nodes).where(F.col("kind").isin("insight", "procedure") & F.exists("tags", lambda t: F.contains(t, F.lit("consolidated"))))
    return rows.select(F.explode(F.filter("tags", lambda t: F.startswith(t, F.lit("member:")))).alias("t")).select(F.substring(F.col("t"), F.lit(8), F.length("t")).alias("id")).distinct()


def clusters(vectors: DataFrame, scratch: Scratch, floor: float = 0.65, least: int = 3, least_sessions: int = 2, block_rows: int | None = None) -> DataFrame:
    """(id, session, kind, cluster): components of the similarity graph with enough nodes and sessions."""
    rows = active(vectors).where(F.col("kind").isin(*CONSOLIDATION_KINDS)).join(absorbed(vectors), "id", "left_anti")
    rows = scratch.save(rows.select("id", "session", "kind", "embedding"))
    pairs = similar_roots(rows, floor, block_rows=block_rows)
    comps = connected_components(pairs.select(F.col("src").alias("u"), F.col("dst").alias("v")), scratch, local_edges=LOCAL_EDGES)
    found = scratch.save(rows.select("id", "session", "kind").join(comps.select(F.col("node").alias("id"), F.col("component").alias("cluster")), "id"))
    big = found.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("session").alias("s")).where((F.col("n") >= least) & (F.col("s") >= least_sessions)).select("cluster")
    return found.join(big, "cluster").select("id", "session", "kind", "cluster")


def medoids(members: DataFrame, vectors: DataFrame) -> DataFrame:
    """(cluster, id, mean): the member with the highest mean cosine to the others, the smallest id at ties.

    The mean cosine of a unit vector to n others is its product with their sum, less itself: one pass over the
    members after one aggregation of their unit vectors, instead of all pairs.
    """
    from ..functions.vectors import dot, norm

    v = members.select("cluster", "id").join(vectors.select("id", "embedding"), "id")
    size = norm(F.col("embedding"))
    v = Scratch(vectors.sparkSession, "medoids").save(v.select("cluster", "id", F.transform("embedding", lambda x: F.when(size > 0, x / size).otherwise(0.0)).alias("u")))
    parts = v.select("cluster", F.posexplode("u").alias("i", "x")).groupBy("cluster", "i").agg(F.sum("x").alias("x"))
    sums = parts.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("total"))
    n = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    mean = (dot(F.col("u"), F.col("total")) - dot(F.col("u"), F.col("u"))) / (F.col("n") - 1)
    rows = v.join(sums, "cluster").join(n, "cluster").where("n > 1").withColumn("mean", F.round(mean, 9))
    return rows.withColumn("r", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("mean"), "id"))).where("r = 1").select("cluster", "id", "mean")


def synthesis(members: DataFrame, medoid: DataFrame, nodes: DataFrame) -> DataFrame:
    """One new node for each cluster: an insight, or a procedure if half of it or more is about method."""
    stats = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("session").alias("s"), F.avg(F.col("kind").isin(*METHOD_KINDS).cast("int")).alias("method"), F.array_sort(F.collect_list(F.concat(F.lit("member:"), F.col("id")))).alias("tags"))
    rows = stats.join(medoid.select("cluster", F.col("id").alias("parent")), "cluster").join(nodes.select(F.col("id").alias("parent"), F.col("query").alias("text")), "parent")
    head = F.concat(F.lit("[consolidated x"), F.col("n").cast("string"), F.lit(" across "), F.col("s").cast("string"), F.lit(" sessions] "))
    return rows.select(F.when(F.col("method") >= 0.5, "procedure").otherwise("insight").alias("kind"), F.substring(F.concat(head, F.coalesce("text", F.lit(""))), 1, 300).alias("query"), "parent", F.concat(F.array(F.lit("consolidated")), F.col("tags")).alias("tags"))


def lesson_words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-z0-9_\-.]{4,}"), F.lit(0)))


def hook_citations(ledger: DataFrame, nodes: DataFrame, corpus: DataFrame, stop: tuple[str, ...] = (), least: int = 2) -> DataFrame:
    """(session, id): hook-shown, uncited nodes of which a session's text holds two gist words or more.

    `corpus` has session and text. Receipts meet the text of their own session only.
    """
    shown = ledger.where((F.col("channel") == "hook") & ~F.col("cited")).select("session", F.col("node_id").alias("id")).distinct()
    words = F.array_distinct(F.filter(F.regexp_extract_all(F.lower(F.coalesce("query", F.lit(""))), F.lit("[a-z][a-z0-9]{4,}"), F.lit(0)), lambda w: ~w.isin(*(stop or ("",)))))
    terms = nodes.select("id", words.alias("terms"))
    rows = shown.join(terms, "id").join(corpus.select("session", F.lower("text").alias("text")), "session")
    return rows.where(F.size(F.filter("terms", lambda w: F.contains(F.col("text"), w))) >= least).select("session", "id")


def lessons(nodes: DataFrame, share: float = 0.34, scratch: Scratch | None = None) -> DataFrame:
    """(struggle, resolution, score): the resolution later in the session that best matches a struggling tool call.

    Sets of words meet on rare words, and each struggle meets the next resolution of each set that matches (`containment`);
    then the best for each struggle, then the best for each resolution; ties by time and id.
    """
    scratch, live = scratch or Scratch(nodes.sparkSession, "lessons"), active(nodes)
    hard = live.where((F.col("kind") == "tool_call") & (F.coalesce(F.col("result_count") == 0, F.lit(False)) | F.coalesce(F.col("latency_ms") > SLOW_MS, F.lit(False))))
    hard = hard.select("session", "id", F.col("ts").alias("at"), lesson_words(F.col("query")).alias("words")).where(F.size("words") > 0)
    text = F.concat_ws(" ", *[c for c in ("gist", "query") if c in nodes.columns])
    done = live.where(F.col("kind").isin("resolved", "decision")).select("session", F.col("id").alias("event"), F.col("ts").alias("t"), lesson_words(text).alias("words"))
    met = next_matching(hard, done, "session", share, scratch, least=3)
    one = met.groupBy("id").agg(F.min(F.struct((-F.col("score")).alias("s"), "t", "event")).alias("x")).select("id", "x.s", F.col("x.event").alias("resolution"))
    one = one.join(hard.select("id", F.col("at").alias("t0")), "id")
    best = one.groupBy("resolution").agg(F.min(F.struct("s", "t0", "id")).alias("x"))
    return best.select(F.col("x.id").alias("struggle"), "resolution", (-F.col("x.s")).alias("score"))


def near_duplicates(incoming: DataFrame, existing: DataFrame, floor: float = 0.45, kinds: tuple[str, ...] = ("decision", "open_item", "warning")) -> DataFrame:
    """(id, match, jaccard): the most similar active node of the same kind for each incoming one, if similar enough.

    Candidates share one of the rarest keywords (prefix filtering): sets with a similarity of `floor` share one of
    the first n - ceil(floor * n) + 1 by rarity. So rows meet on rare words, not on their kind alone.
    """
    def sets(df):
        k = F.array_sort(duplicate_keywords(F.col("query")))
        return df.where(F.col("kind").isin(*kinds)).select("id", "kind", k.alias("k"), F.length("query").alias("len"))

    new = sets(incoming).where((F.coalesce("len", F.lit(0)) >= 20) & (F.size("k") >= 3)).drop("len")
    # texts with the same keywords are one candidate; its two smallest ids are enough, as one may be the incoming node
    first = F.row_number().over(Window.partitionBy("kind", "k").orderBy("id"))
    old = sets(active(existing)).where(F.size("k") > 0).withColumn("r", first).where("r <= 2")
    old = old.groupBy("kind", F.col("k").alias("b")).agg(F.array_sort(F.collect_list("id")).alias("ids"))
    asked = new.select("kind", F.col("k").alias("a")).distinct()
    rarity = old.select(F.explode("b").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("c"))

    def prefixes(df, name):
        words = df.select(name, "kind", F.size(name).alias("n"), F.explode(name).alias("w")).join(rarity, "w", "left")
        at = F.row_number().over(Window.partitionBy("kind", name).orderBy(F.coalesce("c", F.lit(0)), "w"))
        return words.withColumn("r", at).where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * floor) + 1).select(name, "kind", "w")

    met = prefixes(asked, "a").join(prefixes(old, "b"), ["kind", "w"]).select("kind", "a", "b").distinct()
    met = met.withColumn("jaccard", F.size(F.array_intersect("a", "b")) / F.size(F.array_union("a", "b"))).where(F.col("jaccard") >= floor).join(old, ["kind", "b"])
    # for each keyword set the best candidates by score and id: two ids, again because one may be the node itself
    best = met.select("kind", "a", "jaccard", F.explode("ids").alias("match"))
    best = best.withColumn("r", F.row_number().over(Window.partitionBy("kind", "a").orderBy(F.desc("jaccard"), "match"))).where("r <= 2")
    rows = new.withColumnRenamed("k", "a").join(best, ["kind", "a"]).where("id <> match")
    return rows.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("jaccard"), "match"))).where("r = 1").select("id", "match", "jaccard")


def immutability_violations(before: DataFrame, after: DataFrame) -> DataFrame:
    """(id, reason): rows that were deleted or changed other than in the five permitted ways.

    Permitted, each alone: status to void; flag set; a missing embedding filled; tier changed; derived fields
    (stability, exposure, community, a missing gist) changed.
    """
    content = ("session", "kind", "tool", "query", "output_preview", "result_count", "latency_ms", "parent", "ts", "tags", "importance", "model")
    a = before.select("id", F.struct(*content).alias("c0"), *[F.col(x).alias(f"{x}_0") for x in ("status", "flagged", "memory_tier", "embedding", "gist")])
    b = after.select("id", F.struct(*content).alias("c1"), *[F.col(x).alias(f"{x}_1") for x in ("status", "flagged", "memory_tier", "embedding", "gist")])
    same = {x: F.col(f"{x}_0").eqNullSafe(F.col(f"{x}_1")) for x in ("status", "flagged", "memory_tier", "embedding", "gist")}

    def only(changed: str, rule: Column) -> Column:
        out = rule
        for x, s in same.items():
            if x != changed:
                out = out & s
        return out

    allowed = (
        only("", F.lit(True)) | only("status", F.col("status_1") == "void") | only("flagged", F.coalesce(~F.col("flagged_0"), F.lit(True)) & F.col("flagged_1"))
        | only("embedding", F.col("embedding_0").isNull()) | only("memory_tier", F.col("memory_tier_1").between(0, 2)) | only("gist", F.col("gist_0").isNull())
    )
    rows = a.join(b, "id", "left")
    reason = F.when(F.col("c1").isNull(), "deleted").when(~F.col("c0").eqNullSafe(F.col("c1")), "content changed").when(~F.coalesce(allowed, F.lit(False)), "transition not permitted")
    return rows.select("id", reason.alias("reason")).where("reason is not null")


def fold_changes(nodes: DataFrame, changes: DataFrame) -> DataFrame:
    """Nodes with the latest value of every change: rows (id, field, value, at) for status, flagged, memory_tier,
    stability_days and last_injected. Facts stay append-only; a void is final."""
    stamped = "last_injected" in nodes.columns
    latest = changes.groupBy("id").agg(
        F.max(F.when(F.col("field") == "last_injected", F.col("value").try_cast("timestamp"))).alias("_shown"),
        F.max(F.when((F.col("field") == "status") & (F.col("value") == "void"), "void")).alias("_void"), F.bool_or((F.col("field") == "flagged") & (F.col("value") == "true")).alias("_flag"),
        F.max_by(F.when(F.col("field") == "memory_tier", F.col("value")), F.when(F.col("field") == "memory_tier", F.col("at"))).alias("_tier"),
        F.max_by(F.when(F.col("field") == "stability_days", F.col("value")), F.when(F.col("field") == "stability_days", F.col("at"))).alias("_stability"),
    )
    rows = nodes.join(latest, "id", "left")
    if stamped:
        rows = rows.withColumn("last_injected", F.greatest("last_injected", "_shown"))
    return rows.withColumns({
        "status": F.coalesce("_void", "status"), "flagged": F.col("flagged") | F.coalesce("_flag", F.lit(False)),
        "memory_tier": F.coalesce(F.col("_tier").cast("int"), F.col("memory_tier")), "stability_days": F.greatest(F.lit(0.1), F.coalesce(F.col("_stability").cast("double"), F.col("stability_days"))),
    }).drop("_shown", "_void", "_flag", "_tier", "_stability")
