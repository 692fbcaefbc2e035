"""Substring dedup: sliding spans of consecutive sentences, hashed, joined globally, repeats after the first removed."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_BYTE_BASE, _RUN_BASES = 0x9E3779B97F4A7C15, (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True
_CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    """base ** i for i < n."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Powers:
    """Powers of an odd base and of its inverse, as long as asked for so far."""

    def __init__(self, base: int):
        self.base, self.up, self.down = base, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            n = max(n, 2 * len(self.up))
            self.up, self.down = _powers(self.base, n), _powers(pow(self.base, -1, 1 << 64), n)
        return self.up, self.down


def ranges_hashed(values: np.ndarray, first: np.ndarray, behind: np.ndarray, powers: Powers) -> np.ndarray:
    """For each range [first, behind) of `values` the sum of value * base ** place, modulo 2 ** 64."""
    up, down = powers.to(len(values) + 1)
    upto = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=upto[1:])
    return (upto[behind] - upto[first]) * down[first]


def word_hashes(data: np.ndarray, first: np.ndarray, behind: np.ndarray, powers: Powers) -> np.ndarray:
    """64-bit hashes of the words at [first, behind) of bytes, a megabyte or a word at a time."""
    out, at = np.zeros(len(first), np.uint64), 0
    while at < len(first):
        end = max(at + 1, int(np.searchsorted(behind, first[at] + _CHUNK, side="right")))
        start = first[at]
        out[at:end] = ranges_hashed(data[start : behind[end - 1]].astype(np.uint64), first[at:end] - start, behind[at:end] - start, powers)
        at = end
    return mix(out + (behind - first).astype(np.uint64))


@dataclass
class Pieces:
    """Sentences of several texts, one after another. `text`: whose; `start`: byte where each begins in its own text;
    `first`, `behind`: its words among all words; `words`: hashes of these; `begin`: the first sentence of each text."""

    text: np.ndarray
    start: np.ndarray
    first: np.ndarray
    behind: np.ndarray
    words: np.ndarray
    begin: np.ndarray


def sentences(texts: list[bytes], every: int, powers: Powers) -> Pieces:
    """The sentences of texts in UTF-8. A sentence ends with a word that ends in . ! or ?, or before a line break.

    Besides, about one word of `every` ends one, as the hash of the word and the one before it says. So sentences are
    short also where texts have no marks, and a passage has the same ones wherever it stands, but for its first word.
    Words are runs of anything but 0x20 and 0x09-0x0D; blanks belong to the sentence before them.
    """
    data = np.frombuffer(b"\n".join([*texts, b""]).lower(), np.uint8)
    offset = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    blank = np.concatenate([[True], _BLANK[data], [True]])
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    first, behind = edge[0::2], edge[1::2]
    h = word_hashes(data, first, behind, powers)
    text = np.searchsorted(offset, first, side="right") - 1
    breaks = np.concatenate([[0], np.cumsum(data == 10)])
    after = np.concatenate([first[1:], [len(data)]])[: len(first)]
    before = np.concatenate([np.zeros(1, np.uint64), h[:-1]])[: len(h)]
    before[np.flatnonzero(np.diff(text, prepend=-1))] = 0
    cut = _STOP[data[behind - 1]] | (breaks[after] > breaks[behind])
    if every:
        cut |= (mix(h + mix(before)) >> np.uint64(32)) % np.uint64(every) == 0
    last = np.flatnonzero(np.diff(text, append=-1))
    cut[last] = True
    stop = np.flatnonzero(cut) + 1
    start = np.concatenate([[0], stop[:-1]]).astype(np.int64)[: len(stop)]
    own = text[stop - 1]
    begin = np.searchsorted(own, np.arange(len(texts) + 1))
    at = first[start] - offset[own]
    at[begin[:-1][begin[:-1] < begin[1:]]] = 0
    return Pieces(own, at, start, stop, h, begin)


def shortest(p: Pieces, least: int, least_words: int) -> np.ndarray:
    """The last sentence of the shortest run that starts at each sentence, wherever texts end."""
    return np.maximum(np.searchsorted(p.behind, p.first + least_words), np.arange(len(p.text)) + least - 1)


def runs(p: Pieces, least: int, least_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, last sentence, kind) of the shortest run that starts at each sentence (kind 0), and of the shortest that
    ends each text (kind 1) where that is another.

    Shortest: of `least` sentences and `least_words` words or more, all of one text.
    """
    n = np.arange(len(p.text))
    last = shortest(p, least, least_words)
    ok = last < len(n)
    ok[ok] = p.text[last[ok]] == p.text[ok]
    end = p.begin[1:][p.begin[1:] > p.begin[:-1]] - 1
    back = np.minimum(np.searchsorted(p.first, p.behind[end] - least_words, side="right") - 1, end - least + 1)
    fits = back >= 0
    fits[fits] = p.text[back[fits]] == p.text[end[fits]]
    fits[fits] &= last[back[fits]] != end[fits]
    return np.concatenate([n[ok], back[fits]]), np.concatenate([last[ok], end[fits]]), np.repeat([0, 1], [ok.sum(), fits.sum()])


def run_hashes(p: Pieces, a: np.ndarray, b: np.ndarray, powers: tuple[Powers, Powers]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each run: of 64 bits, and of 32 more as a whole number, so that rows stay small."""
    first, behind = p.first[a], p.behind[b]
    size = (behind - first).astype(np.uint64)
    salted = (p.words, mix(p.words))
    h1, h2 = (mix(ranges_hashed(v, first, behind, q) + size) for v, q in zip(salted, powers, strict=True))
    return h1.view(np.int64), (h2 >> np.uint64(32)).view(np.int64)


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of a batch of about a megabyte of text, with the texts as bytes; null counts as empty."""
    texts = [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > _CHUNK:
            yield batch.slice(at, i - at), texts[at:i]
            at, size = i, 0
        size += len(t) + 1
    if at < len(texts):
        yield batch.slice(at), texts[at:]


class Common:
    """The smallest place so far of runs that several texts of a part had; at most `most` of them, by their hashes.

    A place behind one that its own task has seen cannot be the first, so a task passes on few places of a run that
    is everywhere: no more than there are new smallest ones.
    """

    def __init__(self, most: int = 100_000):
        self.most, self.rows = most, np.zeros((4, 0), np.int64)

    def behind(self, rows: np.ndarray, several: np.ndarray) -> np.ndarray:
        """True for places (h1, h2, id, place; sorted, one for each run) behind one seen before; the others are noted."""
        at = np.searchsorted(self.rows[0], rows[0])
        at[at == self.rows.shape[1]] = 0
        known = np.zeros(rows.shape[1], bool)
        if self.rows.shape[1]:
            known = (self.rows[:2, at] == rows[:2]).all(axis=0)
        out = known.copy()
        held = self.rows[2:, at[known]]
        out[known] = (rows[2, known] > held[0]) | ((rows[2, known] == held[0]) & (rows[3, known] > held[1]))
        self.rows[2:, at[known & ~out]] = rows[2:, known & ~out]
        fresh = rows[:, several & ~known][:, : self.most - self.rows.shape[1]]
        if fresh.shape[1]:
            self.rows = np.concatenate([self.rows, fresh], axis=1)
            self.rows = self.rows[:, np.argsort(self.rows[0], kind="stable")]
        return out


def _hashed(least: int, least_words: int, every: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, two, common = Powers(_BYTE_BASE), (Powers(_RUN_BASES[0]), Powers(_RUN_BASES[1])), Common()
        with np.errstate(over="ignore"):
            for batch in batches:
                for part, texts in _slices(batch, 2):
                    p = sentences(texts, every, powers)
                    if not len(p.text):
                        continue
                    a, b, kind = runs(p, least, least_words)
                    text = p.text[a]
                    own = (a - p.begin[text]) * 2 + kind
                    place = (part.column(1).to_numpy(False)[text].astype(np.int64) << 32) | own
                    rows = np.stack([*run_hashes(p, a, b, two), part.column(0).to_numpy(False)[text], place])
                    rows = rows[:, np.lexsort(rows[::-1])]
                    same = np.concatenate([[False], (rows[:2, 1:] == rows[:2, :-1]).all(axis=0)])[: rows.shape[1]]
                    first = np.flatnonzero(~same)
                    lead = np.repeat(first, np.diff(np.append(first, len(same))))
                    later = (rows[2:] != rows[2:, lead]).any(axis=0)  # rows may repeat an id and its text
                    later[first] = common.behind(rows[:, first], np.diff(np.append(first, len(same))) > 1)
                    # places known to be behind another take no part in the comparison: a key of their own spreads them
                    rows[0, later] = mix((rows[2, later] * 31 + rows[3, later]).view(np.uint64)).view(np.int64)
                    rows[1, later] = 0
                    yield pa.RecordBatch.from_arrays([*[pa.array(c) for c in rows], pa.array(later)], names=["h1", "h2", "id", "place", "later"])

    return run


def _cleaned(least: int, least_words: int, every: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers(_BYTE_BASE)
        with np.errstate(over="ignore"):
            for batch in batches:
                for part, texts in _slices(batch, 0):
                    p = sentences(texts, every, powers)
                    sizes = np.diff(p.begin)
                    places, gone, clean = part.column(1), np.zeros(len(texts), np.int32), part.column(0).to_pylist()
                    ends = shortest(p, least, least_words)
                    for i in np.flatnonzero(np.asarray(places.is_valid())):
                        begin, size = p.begin[i], sizes[i]
                        own = np.asarray(places[int(i)].values) & 0xFFFFFFFF
                        at = own >> 1
                        last = np.where(own & 1, size - 1, ends[begin + at] - begin)
                        drop = np.zeros(size + 1, np.int64)
                        np.add.at(drop, at, 1)
                        np.add.at(drop, last + 1, -1)
                        drop = np.cumsum(drop)[:-1] > 0
                        gone[i] = drop.sum()
                        cuts = [*p.start[begin : begin + size], len(texts[i])]
                        clean[i] = b"".join(texts[i][cuts[k] : cuts[k + 1]] for k in np.flatnonzero(~drop)).decode()
                    yield pa.RecordBatch.from_arrays([pa.array(clean, pa.string()), pa.array(sizes.astype(np.int32)), pa.array(gone), *part.columns[2:]], names=["clean_text", "n_sentences", "n_removed", *part.schema.names[2:]])

    return run


def dedup_spans(docs: DataFrame, least: int = 2, least_words: int = 24, every: int = 6, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, clean_text, n_sentences, n_removed, and the columns in `keep`), one row for each row of `docs`.

    Every run of `least` consecutive sentences (more where they have under `least_words` words) is hashed to 96 bits,
    once; runs that occur more than once over all documents keep their first place, the smallest (id, place), and
    sentences covered by any other place are removed. Texts also end sentences at words that their hash picks (`every`,
    see `sentences`), so that a passage need not begin or end with a sentence: one of 51 words without any mark has a
    run of its own with a probability of 0.94 at the defaults, one with marks every dozen words of 0.99, longer ones
    sooner. Comparison ignores the case of A-Z and kinds of blanks.

    A task compares the places that it sees itself and marks those behind another at once (see `Common`), so that of a
    run that a third of all texts hold, each task passes on a few places and no task gets all of them. One shuffle then
    brings the places of a run together, and all but the first are behind it.

    Null stays null and empty stays empty; texts with too few sentences or words stay as they are, as do rows with
    a null id. Very long texts are hashed a megabyte at a time. Rows that repeat an id and a text are one document;
    other texts under that id come in the order of their hashes. An empty table gives an empty result.
    """
    mark = F.shiftrightunsigned(F.coalesce(F.xxhash64(F.col(text_col)), F.lit(0)), 33).cast("int")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), mark.alias("mark"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null")
    places = rows.mapInArrow(_hashed(least, least_words, every), "h1 long, h2 long, id long, place long, later boolean")
    order = F.rank().over(Window.partitionBy("h1", "h2").orderBy("id", "place"))
    later = places.withColumn("r", order).where("later or r > 1").select("id", F.shiftright("place", 32).cast("int").alias("mark"), "place")
    spans = later.groupBy("id", "mark").agg(F.collect_list("place").alias("places"))
    given = docs.select(F.col(text_col).cast("string").alias("_text"), F.col(id_col).cast("long").alias("id"), mark.alias("mark"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)])
    joined = given.join(spans, ["id", "mark"], "left").select("_text", "places", "id", *[f"_k{i}" for i in range(len(keep))])
    extra = [(f"_k{i}", docs.schema[c].dataType.simpleString()) for i, c in enumerate(keep)]
    out = joined.mapInArrow(_cleaned(least, least_words, every), ", ".join(["clean_text string, n_sentences int, n_removed int, id long", *[f"{n} {t}" for n, t in extra]]))
    return out.select(F.col("id").alias("doc_id"), "clean_text", "n_sentences", "n_removed", *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)])
