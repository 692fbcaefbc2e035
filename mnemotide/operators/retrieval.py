"""Hybrid retrieval: composite top-k, keyword fallback, packs under a budget, strong neighbours, weak-tie walks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import PREVIEW_CHARS, QUESTION_STOP, TIME_CUES
from ..functions.vectors import cosine_to, of_dimension
from ..model import active, days_between, not_void
from ..scratch import Scratch

# Weights of relevance, recency, keywords and importance, and the daily decay.
WEIGHTS, TIME_WEIGHTS, DECAY = (0.50, 0.05, 0.25, 0.20), (0.45, 0.25, 0.15, 0.15), 0.07


def is_temporal(question: str) -> bool:
    return re.search(r"\b(?:" + "|".join(map(re.escape, TIME_CUES)) + r")\b", question.lower()) is not None


def weights(question: str) -> tuple[float, float, float, float]:
    return TIME_WEIGHTS if is_temporal(question) else WEIGHTS


def importance_rank() -> Column:
    """Importance as a share of 1; 0.5 where it is null or 0."""
    return F.coalesce(F.nullif(F.col("importance"), F.lit(0)), F.lit(5)) / 10.0


def question_keywords(question: str) -> list[str]:
    words = (w for w in question.lower().split() if len(w) >= 4 and w not in QUESTION_STOP)
    return sorted({w.strip(".,;:!?()'\"") for w in words})


def keyword_share(keywords: list[str], *texts: str) -> Column:
    """The share of keywords that occur in the texts, as parts of words too; 0 without keywords."""
    if not keywords:
        return F.lit(0.0)
    text = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(t), F.lit("")) for t in texts]))
    return sum((F.contains(text, F.lit(k)).cast("int") for k in keywords), F.lit(0)) / F.lit(float(len(keywords)))


def hybrid_search(nodes: DataFrame, question: str, query_vector: list[float], as_of: Column, k: int = 10, session: str | None = None, texts: tuple[str, ...] = ("query", "episodic_text")) -> DataFrame:
    """The k best non-void embedded nodes with `score`, ties by id.

    Score is cosine, exponential recency, keyword share and importance / 10, weighted; a question about time weighs
    recency more. Vectors of another dimension than the question's stay out. One pass without a shuffle but for the k
    rows of each partition.
    """
    w = weights(question)
    rows = of_dimension(not_void(nodes), "embedding", len(query_vector))
    if session is not None:
        rows = rows.where(F.col("session") == session)
    age = F.greatest(F.lit(0.0), days_between(as_of, F.col("ts")))
    score = w[0] * cosine_to("embedding", query_vector) + w[1] * F.exp(-DECAY * age) + w[2] * keyword_share(question_keywords(question), *[t for t in texts if t in nodes.columns]) + w[3] * importance_rank()
    return rows.withColumn("score", score).orderBy(F.desc("score"), "id").limit(k)


def keyword_fallback(nodes: DataFrame, text: str, k: int = 10, cols: tuple[str, ...] = ("query", "output_preview")) -> DataFrame:
    """Newest non-void nodes that contain the text, without case; for stores without vectors."""
    like = F.lit(False)
    for c in cols:
        like = like | F.coalesce(F.contains(F.lower(c), F.lit(text.lower())), F.lit(False))
    return not_void(nodes).where(like).withColumn("score", F.lit(0.0)).orderBy(F.desc("ts"), "id").limit(k)


def pack(hits: DataFrame, budget: int, order: list[Column], most_verbatim: int = 8) -> DataFrame:
    """`hits` (a top-k) with place, text and used: texts while they fit the budget, then gists only.

    Whether a text fits depends on what fitted before, so this is a fold over the k rows, as one expression.
    """
    rows = hits.withColumn("place", F.row_number().over(Window.orderBy(*order)) - 1)
    body = F.coalesce(F.nullif(F.col("output_preview"), F.lit("")), F.col("query"), F.lit(""))
    short = F.coalesce(F.nullif(F.col("gist"), F.lit("")), F.substring("query", 1, 90), F.lit(""))
    rows = rows.withColumns({"body": body, "gist": short})
    one = F.struct("place", "id", "kind", "session", "score", "gist", "body")
    listed = rows.agg(F.array_sort(F.collect_list(one)).alias("rows"))

    def step(acc, r):
        full, brief = F.greatest(F.lit(1), F.floor(F.length(r["body"]) / 4)), F.greatest(F.lit(1), F.floor(F.length(r["gist"]) / 4))
        fits = (acc["used"] + full <= budget) & (r["place"] < most_verbatim)
        used = (acc["used"] + F.when(fits, full).otherwise(brief)).cast("bigint")
        text = F.when(fits, F.substring(r["body"], 1, PREVIEW_CHARS)).otherwise("")
        return F.struct(used.alias("used"), F.array_append(acc["out"], F.struct(r["place"].alias("place"), text.alias("text"), used.alias("used"))).alias("out"))

    start = F.expr("struct(cast(0 as bigint) as used, cast(array() as array<struct<place: int, text: string, used: bigint>>) as out)")
    folded = listed.select(F.explode(F.aggregate("rows", start, step)["out"]).alias("p"))
    return rows.drop("body").join(F.broadcast(folded.select("p.place", "p.text", "p.used")), "place")


def strong_neighbours(edges: DataFrame, nodes: DataFrame, top: DataFrame, most: int = 6, pool: int = 40) -> DataFrame:
    """Active nodes wired to the ids in `top` by strong semantic edges, best edge first; `top` is a few rows."""
    strong = edges.where("type = 'semantic' and tier = 'strong'")
    seeds = F.broadcast(top.select("id").distinct())
    both = strong.select(F.col("src").alias("id"), F.col("dst").alias("other"), "src", "dst", "weight").unionAll(strong.select(F.col("dst").alias("id"), F.col("src").alias("other"), "src", "dst", "weight"))
    touching = both.join(seeds, "id", "left_semi").groupBy("src", "dst").agg(F.max("weight").alias("weight"), F.collect_set("other").alias("others")).orderBy(F.desc("weight"), "src", "dst").limit(pool)
    other = touching.select(F.explode("others").alias("id"), "weight").join(seeds, "id", "left_anti").groupBy("id").agg(F.max("weight").alias("weight"))
    best = other.orderBy(F.desc("weight"), "id").limit(most)
    return active(nodes).join(F.broadcast(best), "id")


def drift_walk(edges: DataFrame, topics: DataFrame, seeds: DataFrame, hops: int = 3, k: int = 10) -> DataFrame:
    """(id, score, hops): nodes within `hops` semantic edges of the seeds, by the best score of a walk.

    Each hop multiplies by the edge's weight, 1.0 / 0.9 / 0.5 for weak / medium / strong ties (0.8 for others), 1.5
    across topics or 0.7 within one, and 0.8. Seeds are never results; a node goes on only when its score improves.
    `topics` has id and topic; nodes without one share the topic null. Unrolled: a join of the frontier with the
    edges for each hop, one aggregation each.
    """
    tie = F.when(F.col("tier") == "weak", 1.0).when(F.col("tier") == "medium", 0.9).when(F.col("tier") == "strong", 0.5).otherwise(0.8)
    w = F.coalesce(F.nullif(F.col("weight"), F.lit(0.0)), F.lit(0.5)) * tie
    one = edges.where("type = 'semantic'").select("src", "dst", w.alias("w"))
    both = one.unionAll(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    t = topics.select("id", "topic")
    both = both.join(t.select(F.col("id").alias("src"), F.col("topic").alias("t1")), "src", "left").join(t.select(F.col("id").alias("dst"), F.col("topic").alias("t2")), "dst", "left")
    both = both.select("src", "dst", (F.col("w") * F.when(F.col("t1").eqNullSafe(F.col("t2")), 0.7).otherwise(1.5) * 0.8).alias("w"))
    start = F.broadcast(seeds.select(F.col("id").alias("seed")).distinct())
    # written once, as every hop reads it
    both = Scratch(edges.sparkSession, "walk").save(both.join(start, F.col("dst") == F.col("seed"), "left_anti"))
    frontier, best = seeds.select("id", F.lit(1.0).alias("score")).distinct(), None
    for hop in range(1, hops + 1):
        found = frontier.join(both, F.col("id") == F.col("src")).groupBy(F.col("dst").alias("id")).agg(F.max(F.col("score") * F.col("w")).alias("score")).withColumn("hops", F.lit(hop))
        if best is None:
            best = frontier = found
        else:
            old = best.select("id", F.col("score").alias("s0"), F.col("hops").alias("h0"))
            met = old.join(found, "id", "full")
            better = F.col("score").isNotNull() & (F.col("s0").isNull() | (F.col("score") > F.col("s0")))
            best = met.select("id", F.when(better, F.col("score")).otherwise(F.col("s0")).alias("score"), F.when(better, F.col("hops")).otherwise(F.col("h0")).alias("hops"))
            frontier = best.where(F.col("hops") == hop)
        frontier = frontier.select("id", "score")
    return best.orderBy(F.desc("score"), "id").limit(k)


def chain(nodes: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, id, kind, step): each id in `starts` and all of its ancestors up to the root; step 0 is the node itself.

    A cycle ends where it closes; a parent that is not there ends the walk. Jumps double: after n rounds a table leads
    from each node to its ancestor 2 ** n steps up, so a lineage of a million steps takes twenty rounds, each a join of
    narrow rows. Nothing cuts the walk.
    """
    scratch = Scratch(nodes.sparkSession, "chain")
    jump = scratch.save(nodes.where("parent is not null").select("id", F.col("parent").alias("up")).join(nodes.select(F.col("id").alias("up")), "up", "left_semi").select("id", "up"))
    found = scratch.save(starts.select(F.col("id").alias("start")).distinct().join(nodes.select(F.col("id").alias("start")), "start", "left_semi").select("start", F.col("start").alias("id"), F.lit(0).cast("long").alias("step")))
    size, reach = found.count(), 1
    while True:
        further = found.join(jump, "id").select("start", F.col("up").alias("id"), (F.col("step") + reach).alias("step"))
        grown = scratch.save(found.unionAll(further).groupBy("start", "id").agg(F.min("step").alias("step")))
        now = grown.count()
        scratch.drop(found)
        found = grown
        if now == size:
            return found.join(nodes.select("id", "kind"), "id").select("start", "id", "kind", F.col("step").cast("int").alias("step"))
        size, reach = now, reach * 2
        doubled = scratch.save(jump.join(jump.select(F.col("id").alias("up"), F.col("up").alias("top")), "up").select("id", F.col("top").alias("up")))
        scratch.drop(jump)
        jump = doubled


def session_scan(nodes: DataFrame, session: str, with_void: bool = False) -> DataFrame:
    """The nodes of one session by time."""
    rows = nodes if with_void else not_void(nodes)
    return rows.where(F.col("session") == session).orderBy("ts", "id")


def keyword_search(nodes: DataFrame, text: str, k: int = 12, cols: tuple[str, ...] = ("query", "episodic_text", "gist")) -> DataFrame:
    """The reading surface's fallback: active nodes of which a text or the gist holds the words, by importance and time."""
    like = F.lit(False)
    for c in cols:
        like = like | F.coalesce(F.contains(F.lower(c), F.lit(text.lower())), F.lit(False))
    return active(nodes).where(like).orderBy(F.desc("importance"), F.desc("ts"), "id").limit(k)


def node_view(nodes: DataFrame, node: str, children: int = 20, holders: int = 5, near: int = 5, bridges: int = 8) -> DataFrame:
    """(section, place, id, similarity, entity): everything around one node.

    Sections: chain (root first), children by time, members that its tags name, nodes whose tags name it, its nearest
    by cosine, and nodes that share one of its first six entities (six by importance for each, eight in all). The node
    itself is one row that is read first; what follows are filters and top-k of one pass each.
    """
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    own = nodes.where(F.col("id") == node).select(F.slice(F.filter(tags, lambda t: F.startswith(t, F.lit("entity:"))), 1, 6).alias("entities"), "embedding").first()
    none = F.lit(None)

    def part(rows: DataFrame, section: str, order: list[Column], similarity: Column | None = None, entity: Column | None = None) -> DataFrame:
        place = F.row_number().over(Window.orderBy(*order))
        return rows.select(F.lit(section).alias("section"), place.alias("place"), "id", (none.cast("double") if similarity is None else similarity).alias("similarity"), (none.cast("string") if entity is None else entity).alias("entity"))

    start = nodes.where(F.col("id") == node).select("id")
    out = part(chain(nodes, start), "chain", [F.desc("step")])
    out = out.unionByName(part(not_void(nodes).where(F.col("parent") == node).orderBy("ts", "id").limit(children), "children", [F.col("ts"), F.col("id")]))
    named = nodes.where(F.col("id") == node).select(F.posexplode(tags).alias("at", "tag")).where(F.startswith("tag", F.lit("member:")))
    named = named.groupBy(F.substring(F.col("tag"), F.lit(8), F.length("tag")).alias("id")).agg(F.min("at").alias("at"))
    out = out.unionByName(part(nodes.join(named, "id"), "members", [F.col("at"), F.col("id")]))
    held = active(nodes).where(F.exists("tags", lambda t: F.contains(t, F.lit(f"member:{node}")))).orderBy("id").limit(holders)
    out = out.unionByName(part(held, "member_of", [F.col("id")]))
    vector = [float(x) for x in own["embedding"]] if own and own["embedding"] is not None else []
    if any(vector):
        alike = of_dimension(active(nodes), "embedding", len(vector)).where(F.col("id") != node).select("id", cosine_to("embedding", vector).alias("c")).orderBy(F.desc("c"), "id").limit(near)
        out = out.unionByName(part(alike, "neighbours", [F.desc("c"), F.col("id")], F.round("c", 3)))
    entities = list(own["entities"]) if own else []
    if entities:
        named = F.filter(F.array(*[F.struct(F.lit(i).alias("e"), F.lit(t).alias("t")) for i, t in enumerate(entities)]), lambda x: F.exists("tags", lambda t: F.contains(t, x["t"])))
        hits = active(nodes).where(F.col("id") != node).select("id", "importance", F.explode(named).alias("x")).select("id", "importance", "x.e", "x.t")
        hits = hits.withColumn("r", F.row_number().over(Window.partitionBy("e").orderBy(F.desc("importance"), "id"))).where("r <= 6")
        first = hits.groupBy("id").agg(F.min(F.struct("e", "r", "t")).alias("b"))
        first = first.orderBy("b.e", "b.r").limit(bridges)
        out = out.unionByName(part(first, "entities", [F.col("b.e"), F.col("b.r")], None, F.substring(F.col("b.t"), F.lit(8), F.length("b.t"))))
    return out


def collisions(nodes: DataFrame, idea_id: str, vector: list[float], tags: list[str], low: float = 0.35, high: float = 0.85, k: int = 4, ignored: tuple[str, ...] = ("backfill",)) -> DataFrame:
    """Thoughts at a middling distance from an idea; 0.15 more for those that share no tag with it."""
    own = [t for t in tags if t not in ignored]
    shared = F.arrays_overlap("tags", F.array(*[F.lit(t) for t in own])) if own else F.lit(False)
    rows = active(nodes).where(F.col("kind").isin("idea", "insight", "hypothesis", "question") & (F.col("id") != idea_id) & F.col("embedding").isNotNull())
    rows = rows.withColumn("cosine", cosine_to("embedding", vector)).where(F.col("cosine").between(low, high))
    return rows.withColumn("score", F.col("cosine") + F.when(F.coalesce(shared, F.lit(False)), 0.0).otherwise(0.15)).orderBy(F.desc("score"), "id").limit(k)


def lookup(nodes: DataFrame, prefixes: list[str]) -> DataFrame:
    """(prefix, matches, id, status) for at most eight id prefixes: none, hit, or ambiguous. More are an error."""
    if len(prefixes) > 8:
        raise ValueError(f"{len(prefixes)} prefixes were asked for, and the tool takes eight")
    asked = nodes.sparkSession.createDataFrame([(p,) for p in dict.fromkeys(prefixes)], "prefix string")
    like = F.lit(False)
    for p in prefixes:
        like = like | F.startswith("id", F.lit(p))
    found = nodes.where(like).select("id").join(F.broadcast(asked), F.startswith("id", F.col("prefix")))
    counts = found.groupBy("prefix").agg(F.count(F.lit(1)).alias("matches"), F.min("id").alias("id"))
    out = asked.join(counts, "prefix", "left").withColumn("matches", F.coalesce("matches", F.lit(0)))
    return out.select("prefix", "matches", F.when(F.col("matches") == 1, F.col("id")).alias("id"), F.when(F.col("matches") == 0, "none").when(F.col("matches") == 1, "hit").otherwise("ambiguous").alias("status"))


BODY = ("query", "output_preview", "episodic_text")


def canonical_body(cols: tuple[str, ...] = BODY) -> Column:
    """The longest of the texts, the first at ties."""
    texts = [F.coalesce(F.col(c), F.lit("")) for c in cols]
    out = texts[-1]
    for i in range(len(texts) - 2, -1, -1):
        out = F.when(F.length(texts[i]) >= F.greatest(*[F.length(t) for t in texts[i:]]), texts[i]).otherwise(out)
    return out


def extra_texts(body: Column, cols: tuple[str, ...] = BODY) -> Column:
    """The other texts that the body does not hold, as an array of (field, text).

    A text is held if it occurs in the body, whole or without a head of at most 40 characters before its first colon.
    """
    def bare(t: Column) -> Column:
        at = F.instr(t, F.lit(": "))
        return F.when((at > 0) & (at <= 41), F.substring(t, at + 2, F.length(t))).otherwise(t)

    every = F.array(*[F.struct(F.lit(c).alias("field"), F.coalesce(F.col(c), F.lit("")).alias("text")) for c in cols])
    return F.filter(every, lambda x: (x["text"] != "") & ~F.contains(body, x["text"]) & ~F.contains(body, bare(x["text"])))


def read_nodes(nodes: DataFrame, ids: list[str], each: int = 24_000, total: int = 60_000, extra: int = 500, cols: tuple[str, ...] = BODY) -> DataFrame:
    """(place, id, body, extras, cut): at most eight nodes in the order asked for.

    Bodies of at most `each` characters, together with the extras (`extra` characters of each) at most `total`, or `each`
    if that is more; what comes after is null. `cut` tells that a body goes on.
    """
    if len(ids) > 8:
        raise ValueError(f"{len(ids)} ids were asked for, and the tool takes eight")
    each = max(200, each)
    total = max(total, each)
    order = F.create_map(*[F.lit(x) for n in dict.fromkeys(ids) for x in (n, ids.index(n))])
    rows = nodes.where(F.col("id").isin(*ids)).select(order[F.col("id")].alias("place"), "id", *cols).withColumn("whole", canonical_body(cols))
    rows = rows.withColumn("extras", F.transform(extra_texts(F.col("whole"), cols), lambda x: F.struct(x["field"], F.substring(x["text"], 1, extra).alias("text"))))
    size = F.least(F.length("whole"), F.lit(each)) + F.aggregate("extras", F.lit(0), lambda n, x: n + F.length(x["text"]))
    before = F.coalesce(F.sum(size).over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("room", F.least(F.lit(each), F.lit(total) - before).cast("int"))
    fits = F.col("room") > 0
    return rows.select("place", "id", F.when(fits, F.substring(F.col("whole"), F.lit(1), F.col("room"))).alias("body"), F.when(fits, F.col("extras")).alias("extras"), (fits & (F.length("whole") > F.col("room"))).alias("cut"))
