"""MinHash near-dedup: fast similarity sketching (Dahlgaard, Knudsen, Thorup, 2017), banding, exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..scratch import Scratch
from .vec_dedup import local_roots

_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """64-bit hashes of words; starts anew when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out


def shingle_set(text: str | None, width: int, words: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of `width` words; a shorter text is one run; none without words.

    bytes.lower() changes A-Z only, and bytes.split() cuts at 0x20 and 0x09-0x0D only.
    """
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    h = np.array([words[t] for t in tokens], np.uint64)
    width = min(width, len(h))
    n = len(h) - width + 1
    out = np.full(n, width, np.uint64)
    for j in range(width):
        out = mix(out * _ODD + h[j : j + n])
    return np.unique(out)


def fast_similarity_sketch(elements: np.ndarray, coordinates: int, seed: int = 0) -> np.ndarray:
    """One value for each coordinate; two sets agree in a coordinate with the probability of their similarity.

    Round i < t hashes every element into one bin with value (i, hash), so a bin keeps what its earliest round
    put there. Round t + j puts every element into bin j, so that after 2t rounds every bin is filled.
    """
    t, n = coordinates, len(elements)
    bins = np.full(t, np.iinfo(np.uint64).max, np.uint64)
    step, at = max(1, 2048 // n), 0
    with np.errstate(over="ignore"):
        while at < t and (bins == np.iinfo(np.uint64).max).any():
            rounds = np.arange(at, min(t, at + step), dtype=np.uint64)
            h = mix(elements[None, :] ^ mix(rounds + np.uint64(1 + seed * 2 * t))[:, None])
            where = ((h >> np.uint64(40)) * np.uint64(t)) >> np.uint64(24)
            value = (rounds[:, None] << np.uint64(54)) | (mix(h) >> np.uint64(10))
            np.minimum.at(bins, where.ravel().astype(np.int64), value.ravel())
            at += len(rounds)
        for j in np.flatnonzero(bins == np.iinfo(np.uint64).max):
            r = np.uint64(t + j)
            h = mix(elements ^ mix(r + np.uint64(1 + seed * 2 * t)))
            bins[j] = (r << np.uint64(54)) | (h.min() >> np.uint64(10))
    return bins


def band_keys(sketch: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each run of `rows` coordinates; the band's number is part of it."""
    parts = sketch.reshape(-1, rows)
    with np.errstate(over="ignore"):
        out = mix(np.arange(1, len(parts) + 1, dtype=np.uint64))
        for j in range(rows):
            out = mix(out * _ODD + parts[:, j])
    return out


def _sketches(width: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                sizes, prints, keys = [], [], []
                for text in part.column(1).to_pylist():
                    found = shingle_set(text, width, words)
                    sizes.append(len(found))
                    if len(found):
                        digest = xxhash.xxh3_128_digest(found.tobytes())
                        prints.append((int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)))
                        keys.append(band_keys(fast_similarity_sketch(found, bands * rows), rows).view(np.int64))
                    else:
                        prints.append((None, None))
                        keys.append([])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.int64()), pa.array([p[0] for p in prints], pa.int64()), pa.array([p[1] for p in prints], pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["id", "n", "f1", "f2", "keys"]
                )

    return run


def intersections(a: list[np.ndarray], b: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Exact sizes of the intersections of all sets in a with all in b, by products of membership matrices."""
    out = np.zeros((len(a), len(b)), np.float64)
    shared = np.intersect1d(np.unique(np.concatenate(a)), np.unique(np.concatenate(b))) if a is not b else None
    if shared is None:
        values, counts = np.unique(np.concatenate(a), return_counts=True)
        shared = values[counts > 1]

    def marks(sets):
        rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        flat = np.concatenate(sets)
        at = np.searchsorted(shared, flat)
        at[at == len(shared)] = 0
        keep = shared[at] == flat
        rows, at = rows[keep], at[keep]
        order = np.argsort(at, kind="stable")
        return rows[order], at[order]

    if not len(shared):
        return out
    ra, ca = marks(a)
    rb, cb = (ra, ca) if a is b else marks(b)
    for c in range(0, len(shared), columns):
        m = np.zeros((len(a), columns), np.float32)
        s = slice(*np.searchsorted(ca, [c, c + columns]))
        m[ra[s], ca[s] - c] = 1
        if a is b:
            out += m @ m.T
        else:
            k = np.zeros((len(b), columns), np.float32)
            s = slice(*np.searchsorted(cb, [c, c + columns]))
            k[rb[s], cb[s] - c] = 1
            out += m @ k.T
    return out


def _verify(width: int, percent: int):
    """Links inside a block, or between the two blocks of a task, as edges to local roots."""

    def run(key, table):
        words = _Words()
        within = key[1].as_py() == key[2].as_py()
        ids, side = np.asarray(table.column("id").combine_chunks()), np.asarray(table.column("side").combine_chunks())
        order = np.lexsort((ids, side))
        texts = table.column("text").combine_chunks()
        sets = [shingle_set(texts[int(i)].as_py(), width, words) for i in order]
        ids, side = ids[order], side[order]
        full = np.array([len(s) for s in sets], np.int64)
        left = np.flatnonzero((full > 0) & (within | (side == key[1].as_py())))
        right = left if within else np.flatnonzero((full > 0) & (side != key[1].as_py()))
        x = y = np.zeros(0, np.int64)
        if len(left) and len(right):
            a = [sets[i] for i in left]
            b = a if within else [sets[i] for i in right]
            both = intersections(a, b)
            union = full[left][:, None] + full[right][None, :] - both
            hit = 100 * both >= percent * union
            if within:
                hit = np.triu(hit, 1)
            x, y = np.nonzero(hit)
            x, y = left[x], right[y]
        root = local_roots(len(ids), x, y)
        at = np.flatnonzero(root != np.arange(len(ids)))
        return pa.table({"u": ids[root[at]], "v": ids[at]})

    return run


_EDGES = "u long, v long"


def _block_pairs(members: DataFrame, texts: DataFrame, block_rows: int, block_shingles: int) -> DataFrame:
    """(g, a, b, side, id, text) of `members` (g, id, n): the blocks of each group, dealt out as pairs of blocks.

    A block has about `block_rows` rows and `block_shingles` shingles at most, but for a longer text, which is in one.
    """
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / block_rows, F.sum("n") / block_shingles))
    sizes = members.groupBy("g").agg(F.greatest(blocks, F.lit(1)).cast("int").alias("blocks"))
    dealt = members.join(sizes, "g").withColumn("side", F.pmod(F.xxhash64("id", F.lit(5)), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("g", F.least("side", "other").alias("a"), F.greatest("side", "other").alias("b"), "side", "id")
    return dealt.join(texts, "id")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = 32, rows: int = 5, block_rows: int = 256, block_shingles: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): documents linked at a Jaccard similarity of `percent` or more.

    Equal shingle sets first collapse to their smallest id, so copies cost one narrow grouping. Sketches of
    bands * rows coordinates give a key for each band. Documents gather at the smallest id they meet in any
    band, and every such group is verified on full sets by exact matrix products, in pairs of blocks when it is
    large, returning links to local roots and never all pairs. Keys whose documents met in several groups, and
    are not all connected yet, are verified in the same way, once for each set of documents, so nothing that
    shares a band is dropped and no pair is ever a row.

    Null and empty texts have n_shingles 0 and link with nothing. Rows with a null id pass through alone. Rows
    that repeat an id are one document: texts of all of them count. Blocks are bounded by shingles as well as by
    rows, so a task holds two blocks whatever the texts' length. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sketched = scratch.save(texts.mapInArrow(_sketches(width, bands, rows), "id long, n long, f1 long, f2 long, keys array<long>"))
    able = sketched.where("f1 is not null and id is not null")
    # tables of groups are written before rows join them, so that a large group's side of the join can be split
    classes = scratch.save(able.groupBy("f1", "f2").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("keys").alias("keys")))
    banded = classes.select("rep", "n", F.explode("keys").alias("key"))
    hubs = scratch.save(banded.groupBy("key").agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("met")).where("met > 1").select("key", "hub"))
    hits = scratch.save(banded.join(hubs, "key"))
    homes = scratch.save(hits.groupBy("rep").agg(F.min("hub").alias("home"), F.max("n").alias("n")))
    # only documents that met another one move their text again
    near = scratch.save(texts.join(homes.select(F.col("rep").alias("id")), "id"))

    # a hub belongs to its own group too; its size counts once, where its own home is that group
    own = homes.select(F.col("home").alias("g"), F.col("rep").alias("id"), "n").unionAll(homes.select(F.col("home").alias("g"), F.col("home").alias("id"), F.lit(0).cast("long").alias("n")))
    own = own.groupBy("g", "id").agg(F.max("n").alias("n"))
    edges = scratch.save(_block_pairs(own, near, block_rows, block_shingles).groupBy("g", "a", "b").applyInArrow(_verify(width, percent), _EDGES))
    comps = scratch.save(connected_components(edges, scratch))

    label = homes.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "home", F.coalesce("component", "rep").alias("comp"))
    seen = hits.select("key", "rep", "n").join(label, "rep")
    # the digest tells sets of documents apart; of the keys that have the same one, the smallest stands for all
    digest = [F.count(F.lit(1)).alias("met"), F.bit_xor(F.xxhash64("rep")).alias("x1"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("x2")]
    apart = seen.groupBy("key").agg(F.min("home").alias("h0"), F.max("home").alias("h1"), F.min("comp").alias("c0"), F.max("comp").alias("c1"), *digest)
    apart = scratch.save(apart.where("h0 <> h1 and c0 <> c1").groupBy("met", "x1", "x2").agg(F.min("key").alias("key")).select("key"))
    if not apart.isEmpty():
        rest = scratch.save(hits.join(apart, "key").select(F.col("key").alias("g"), F.col("rep").alias("id"), "n"))
        more = _block_pairs(rest, near, block_rows, block_shingles).groupBy("g", "a", "b").applyInArrow(_verify(width, percent), _EDGES)
        comps = connected_components(comps.select(F.col("component").alias("u"), F.col("node").alias("v")).unionAll(more), scratch)

    reps = able.select("id", "f1", "f2").join(classes.select("f1", "f2", "rep"), ["f1", "f2"])
    placed = reps.select("id", "rep").join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("id", F.coalesce("component", "rep").alias("component"))
    placed = placed.groupBy("id").agg(F.min("component").alias("component"))
    out = sketched.select("id", "n").join(placed, "id", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
