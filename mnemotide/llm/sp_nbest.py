"""SentencePiece encoding and decoding: forward Viterbi scores guide a backward A* search for the N best pieces."""

from __future__ import annotations

import gc
import sys
from array import array
from collections.abc import Iterator
from heapq import heappop, heappush, nsmallest
from itertools import chain
from operator import itemgetter
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = "▁"
UNKNOWN_PENALTY = 10.0


class Pieces:
    """The vocabulary of a model: pieces with scores, byte pieces, and the score of a character that has no piece."""

    def __init__(self, pieces: list[tuple[str, float, int]], byte_ids: dict[int, int], unknown_id: int):
        self.pieces, self.byte_ids, self.unknown_id = pieces, byte_ids, unknown_id
        # pieces that a model marks as unreachable have an extreme score and do not set the scale
        usual = [s for _, s, _ in pieces if s > -1e8]
        self.unknown_score = min(usual, default=0.0) - UNKNOWN_PENALTY

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        special = lambda i: sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)
        every = range(sp.get_piece_size())
        bytes_ = {int(sp.id_to_piece(i)[3:5], 16): i for i in every if sp.is_byte(i)}
        return cls([(sp.id_to_piece(i), sp.get_score(i), i) for i in every if not sp.is_byte(i) and not special(i)], bytes_, sp.unk_id())


class Segmenter(dict):
    """Segment -> (the best ids as int32 bytes, their score, gap to the second best, decoded text, all).

    `all` is the segment itself, whose N best `ways` looks for when a text asks for them, or names the segments that
    combine to this one. A text differs from its best in the parts with the N - 1 smallest gaps at most, so of most segments
    only the best and the gap are ever needed. Bytes make joining and hashing a text's ids one call each.

    A dictionary that fills itself. At `capacity` entries it becomes the older generation, from which entries come
    back when they are met again, so its memory is bounded and frequent segments stay.
    """

    def __init__(self, pieces: Pieces, nbest: int, capacity: int = 300_000):
        super().__init__()
        self.nbest, self.capacity, self.older, self.searched = nbest, capacity, {}, {}
        self.byte_ids, self.unknown_id, self.unknown_score = pieces.byte_ids, pieces.unknown_id, pieces.unknown_score
        table: dict = {}
        for p, s, i in pieces.pieces:
            for k in range(1, len(p)):
                table.setdefault(p[k:], None)
            table[p] = (s, i)
        self.table = table
        self.longest = max(map(len, table), default=1)
        self.inside = {p[k : k + 2] for p, _, _ in pieces.pieces for k in range(len(p) - 1)}
        self.words_apart = not any(pair[1] == SPACE != pair[0] for pair in self.inside)
        self.before, self.edges = "", [[(0.0, 0, 0.0, -1)]]
        self.text_of = {i: p.replace(SPACE, " ") for p, _, i in pieces.pieces}
        self.byte_of = {i: b for b, i in pieces.byte_ids.items()}

    def __missing__(self, segment: str):
        if len(self) >= self.capacity:
            self.older = dict(self)
            self.clear()
        out = self.older.get(segment)
        if out is None:
            score, ids, gap = self.best(segment)
            out = (array("i", ids).tobytes(), score, gap, self.text(ids), segment)
        self[segment] = out
        return out

    def fallback(self, char: str) -> tuple[int, ...]:
        if not self.byte_ids:
            return (self.unknown_id,)
        return tuple(self.byte_ids[b] for b in char.encode("utf-8", "surrogatepass"))

    def lattice(self, segment: str) -> list[list]:
        """Forward Viterbi: for each place the edges (best score through it, start, score, id) that end there, the best
        edge first. Places that lie in the prefix shared with the segment before are taken over, so that segments
        in alphabetical order share most of their work.
        """
        get, longest, edges, unknown = self.table.get, self.longest, self.edges, self.unknown_score
        n, same = len(segment), 0
        for x, y in zip(segment, self.before, strict=False):
            if x != y:
                break
            same += 1
        del edges[same + 1 :]
        self.before = segment
        for j in range(same + 1, n + 1):
            i = j - 1
            hit = get(segment[i:j], 0)
            at = edges[i][0][0]
            own = [(at + hit[0], i, hit[0], hit[1])] if hit else [(at + unknown, i, unknown, -1)]
            if hit != 0:
                top = own[0][0]
                stop = j - longest if j > longest else 0
                while i > stop:
                    i -= 1
                    hit = get(segment[i:j], 0)
                    if hit:
                        through = edges[i][0][0] + hit[0]
                        if through > top:
                            own.insert(0, (through, i, hit[0], hit[1]))
                            top = through
                        else:
                            own.append((through, i, hit[0], hit[1]))
                    elif hit == 0:
                        break
            edges.append(own)
        return edges

    def best(self, segment: str) -> tuple[float, list[int], float]:
        """(score, ids, gap to the second best) of the best segmentation. The second best leaves the best path at one place
        for the next edge there, and has that edge's Viterbi score before it."""
        edges = self.lattice(segment)
        score, at, behind, second, path = edges[-1][0][0], len(segment), 0.0, float("-inf"), []
        while at:
            own = edges[at]
            for e in own[1:]:
                if e[0] + behind > second:
                    second = e[0] + behind
            _, start, part, piece = own[0]
            if piece >= 0:
                path.append(piece)
            else:
                path += self.fallback(segment[start])[::-1]
            behind += part
            at = start
        path.reverse()
        return score, path, score - second

    def search(self, segment: str) -> list[tuple[float, list[int]]]:
        """The N best segmentations as (score, ids), best first, by backward A*.

        What is behind a hypothesis has its exact score, and what is before it the forward Viterbi score, so the
        next hypothesis in the queue always begins the next best path, and its rest follows the Viterbi edges:
        on the way only the other edges of each place enter the queue. A hypothesis shares its parent's path, from
        the end up to its own edge. Ties go to the one that entered first. When one path is left to find, only the
        front of the queue matters and is all that is kept.
        """
        edges = self.lattice(segment)
        queue, count, found, nbest = [], 0, [], self.nbest
        f, at, behind, path = edges[-1][0][0], len(segment), 0.0, []
        while True:
            missing = nbest - len(found) - 1
            top, hold = float("-inf"), None
            while at:
                own = edges[at]
                if missing and len(own) > 1:
                    if missing == 1:
                        for e in own[1:]:
                            if e[0] + behind > top:
                                top = e[0] + behind
                                hold = (e, behind, path, len(path))
                    else:
                        for e in own[1:]:
                            count += 1
                            heappush(queue, (-(e[0] + behind), count, e, behind, path, len(path)))
                _, start, score, piece = own[0]
                if piece >= 0:
                    path.append(piece)
                else:
                    path += self.fallback(segment[start])[::-1]
                behind += score
                at = start
            found.append((f, path[::-1]))
            if hold and (not queue or top > -queue[0][0]):
                heappush(queue, (-top, count + 1, *hold))
            if not queue or not missing:
                return found
            f, _, (_, at, score, piece), behind, path, shared = heappop(queue)
            f, behind = -f, behind + score
            path = path[:shared] + ([piece] if piece >= 0 else list(self.fallback(segment[at])[::-1]))

    def segments(self, marked: str) -> list[str]:
        """`marked` cut wherever no piece holds the two characters that meet: no piece crosses there, so segments have
        independent lattices. Before a blank's mark that is so unless blanks meet."""
        inside, parts, at = self.inside, [], 0
        for i in range(1, len(marked)):
            if marked[i - 1 : i + 1] not in inside:
                parts.append(marked[at:i])
                at = i
        if marked:
            parts.append(marked[at:])
        return parts

    def encode(self, text: str) -> list[tuple[float, list[int]]]:
        """The N best segmentations of a whole text as (score, ids), best first."""
        return [(score, list(array("i", ids))) for score, ids in self.joined(text)[0]]

    def word(self, word: str):
        """The entry of a word with its blank: of its only segment, or combined from several."""
        segments = self.segments(SPACE + word)
        return self[segments[0]] if len(segments) == 1 else self.combined(segments)

    def encode_all(self, texts: pa.Array) -> list[tuple[list[tuple[float, bytes]], str]]:
        """`joined` for each text of an Arrow string array without nulls."""
        return [([way[:2] for way in ways], back) for ways, back in self.decoded_all(texts)]

    def decoded_all(self, texts: pa.Array) -> list[tuple[list[tuple[float, bytes, str]], str]]:
        """`whole` for each text of an Arrow string array without nulls.

        Arrow cuts the texts at blanks and numbers the distinct words; only these are looked up, in alphabetical
        order, so that new ones share their prefixes' work. A text in which blanks meet, or that begins with one or
        holds the blank's own mark, goes through its segments instead, as words are not independent there.
        """
        odd = pc.or_(pc.or_(pc.match_substring(texts, "  "), pc.starts_with(texts, " ")), pc.or_(pc.match_substring(texts, SPACE), pc.equal(texts, "")))
        odd = np.asarray(odd) | (not self.words_apart)
        out: list = [None] * len(texts)
        for i in np.flatnonzero(odd):
            out[i] = self.whole(texts[int(i)].as_py())
        plain = np.flatnonzero(~odd)
        if not len(plain):
            return out
        cut = pc.split_pattern(texts.take(pa.array(plain)), " ")
        coded = cut.flatten().dictionary_encode()
        codes, words, ends = np.asarray(coded.indices), coded.dictionary.to_pylist(), np.asarray(cut.offsets) - cut.offsets[0].as_py()
        entries = list(map(self.get, map(SPACE.__add__, words)))  # known words of one segment
        for i in sorted((i for i, e in enumerate(entries) if e is None), key=words.__getitem__):
            entries[i] = self.word(words[i])
        score, gaps = np.array([e[1] for e in entries])[codes], np.array([e[2] for e in entries])[codes]
        first, texts_of = np.empty(len(words), object), np.empty(len(words), object)
        first[:], texts_of[:] = [e[0] for e in entries], [e[3] for e in entries]
        for i, a, b in zip(plain, ends[:-1], ends[1:], strict=True):
            own = codes[a:b]
            ids, best, gap, back = first[own].tolist(), float(score[a:b].sum()), gaps[a:b], texts_of[own].tolist()
            ways = [(best, b"".join(ids), "".join(back))]
            if self.nbest > 1:
                k = min(self.nbest - 1, b - a)
                near = [int(gap.argmin())] if k == 1 else np.argsort(gap, kind="stable")[:k].tolist()
                ways += self.others(ways[0], ids, back, near, [self.ways(entries[own[j]]) for j in near])
            out[i] = (ways, ways[0][2][1:])
        return out

    def others(self, first: tuple[float, bytes, str], ids: list[bytes], texts: list[str], near: list[int], choices: list[list[tuple[float, bytes, str]]]) -> list[tuple[float, bytes, str]]:
        """The second to the N-th best of independent parts, each with its decoded text: only the parts `near` the next best can
        differ. Parts decode by themselves, so a way is decoded in the parts where it differs from the `first`, whose text it
        has where all of these read the same."""
        best, _, whole = first
        if len(choices) == 1 and self.nbest == 2:
            c = choices[0]
            if len(c) < 2:
                return []
            other, at = ids.copy(), near[0]
            other[at] = c[1][1]
            return [(best - c[0][0] + c[1][0], b"".join(other), whole if c[1][2] == texts[at] else "".join([*texts[:at], c[1][2], *texts[at + 1 :]]))]
        def gap(pick: tuple) -> float:
            return sum((c[0][0] - c[i][0] for c, i in zip(choices, pick, strict=True)), 0.0)

        # Choices in the order of (gap, pick): each follows from the one with its last raised part lowered, which comes before it.
        start = (0,) * len(choices)
        heap, out = [(0.0, start, 0)], []
        while heap and len(out) < self.nbest:
            lost, pick, last = heappop(heap)
            other, read = ids.copy(), texts
            for at, c, i in zip(near, choices, pick, strict=True):
                if i:
                    other[at] = c[i][1]
                    if c[i][2] != texts[at]:
                        read = texts.copy() if read is texts else read
                        read[at] = c[i][2]
            out.append((best - lost, b"".join(other), whole if read is texts else "".join(read)))
            for j in range(last, len(choices)):
                if pick[j] + 1 < len(choices[j]):
                    raised = (*pick[:j], pick[j] + 1, *pick[j + 1 :])
                    heappush(heap, (gap(raised), raised, j))
        return out[1:]

    def combined(self, segments: list[str]):
        """The entry of a run of segments from theirs; segments are independent, so the best run joins their best."""
        if len(segments) > 8:
            hits = list(map(self.__getitem__, segments))
            ids, score, text = b"".join(map(itemgetter(0), hits)), sum(map(itemgetter(1), hits)), "".join(map(itemgetter(3), hits))
            return ids, score, min(map(itemgetter(2), hits)), text, tuple(segments)
        ids, score, gap, text = b"", 0.0, float("inf"), ""
        for segment in segments:
            hit = self[segment]
            ids += hit[0]
            score += hit[1]
            text += hit[3]
            if hit[2] < gap:
                gap = hit[2]
        return ids, score, gap, text, tuple(segments)

    def ways(self, entry) -> list[tuple[float, bytes, str]]:
        """The N best of an entry as (score, ids as bytes, decoded text): as found, or from the segments that it was combined from.

        All but the best differ from it in the N - 1 segments with the smallest gaps at most.
        """
        if isinstance(entry[4], str):
            found = self.searched.get(entry[4])
            if found is None:
                if len(self.searched) >= self.capacity // self.nbest:
                    self.searched.clear()
                read = lambda ids: entry[3] if (text := self.text(ids)) == entry[3] else text  # noqa: E731  equal texts are held once
                found = self.searched[entry[4]] = [(score, array("i", ids).tobytes(), read(ids)) for score, ids in self.search(entry[4])]
            return found
        hits = list(map(self.__getitem__, entry[4]))
        first = (entry[1], entry[0], entry[3])
        if self.nbest == 1:
            return [first]
        gaps = list(map(itemgetter(2), hits))
        near = [gaps.index(min(gaps))] if self.nbest == 2 else nsmallest(self.nbest - 1, range(len(gaps)), key=gaps.__getitem__)
        return [first, *self.others(first, list(map(itemgetter(0), hits)), list(map(itemgetter(3), hits)), near, [self.ways(hits[i]) for i in near])]

    def joined(self, text: str) -> tuple[list[tuple[float, bytes]], str]:
        """(the N best as (score, ids as bytes), the best one's decoded text) of a whole text."""
        ways, back = self.whole(text)
        return [way[:2] for way in ways], back

    def whole(self, text: str) -> tuple[list[tuple[float, bytes, str]], str]:
        """`joined` with each way's decoded text, before which the blank of encoding still stands."""
        if not text:
            return [(0.0, b"", "")], ""
        entry = self.combined(self.segments(SPACE + text.replace(" ", SPACE)))
        return self.ways(entry), entry[3][1:]

    def decode(self, ids: list[int]) -> str:
        """The text of pieces, without the blank that encoding put before it."""
        return self.text(ids)[1:]

    def text(self, ids) -> str:
        """The text of pieces; runs of byte pieces are decoded together."""
        try:
            return "".join(map(self.text_of.__getitem__, ids))
        except KeyError:  # byte pieces or the unknown one
            out = list(map(self.text_of.get, ids))
            found, at = [], 0
            while at < len(out):
                end = at
                while end < len(out) and out[end] is None:
                    end += 1
                if end == at:
                    found.append(out[at])
                    at += 1
                    continue
                known = bytes(self.byte_of[i] for i in ids[at:end] if i in self.byte_of)
                found.append(known.decode("utf-8", "replace") if known else "⁇")
                at = end
            return "".join(found)


def _shared_segmenter(pieces: Pieces, nbest: int) -> Segmenter:
    """One segmenter for each vocabulary and N in a worker process, so that tasks of a worker share what was searched.

    Functions travel by value and have no globals of their own there; a module entry outlives the task.
    """
    held = sys.modules.setdefault("_mnemotide_segmenters", ModuleType("_mnemotide_segmenters")).__dict__
    key = xxhash.xxh3_64_hexdigest(repr((sorted(pieces.pieces), pieces.byte_ids, nbest)).encode())
    if key not in held:
        for old in [k for k in held if not k.startswith("__")]:
            del held[old]
        held[key] = Segmenter(pieces, nbest)
    return held[key]


def _encoded(shared, nbest: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _shared_segmenter(shared.value, nbest)
        gc.disable()  # tuples and strings without cycles; looking for these costs a quarter of the time
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                sizes, scores, digests, trips, all_trips, ids = [], [], [], [], [], []
                texts = part.column(0).fill_null("")
                for text, (ways, back) in zip(texts.to_pylist(), m.decoded_all(texts), strict=True):
                    same, first = back == text, ways[0][2]
                    sizes.append(len(ways[0][1]) // 4)
                    scores.append([s for s, _, _ in ways])
                    digests.append([xxhash.xxh3_64_hexdigest(w) for _, w, _ in ways])
                    trips.append(same)
                    all_trips.append([same if read is first else read[1:] == text for _, _, read in ways])
                    if with_ids:
                        ids.append([list(array("i", w)) for _, w, _ in ways])
                cols = [pa.array(sizes, pa.int32()), pa.array(scores, pa.list_(pa.float64())), pa.array(digests, pa.list_(pa.string())), pa.array(trips), pa.array(all_trips, pa.list_(pa.bool_()))]
                if with_ids:
                    cols.append(pa.array(ids, pa.list_(pa.list_(pa.int32()))))
                names = ["n_pieces", "scores", "digests", "round_trip", "round_trips", "ids"][: len(cols)]
                yield pa.RecordBatch.from_arrays([*cols, *part.columns[1:]], names=[*names, *part.schema.names[1:]])

    return run


def nbest_pieces(docs: DataFrame, pieces: Pieces, nbest: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, n_pieces, scores, digests, round_trip, round_trips, and ids if `with_ids`), one row for each row of `docs`.

    `scores` and `digests` (xxh3-64 of the int32 ids) are of the N best segmentations, best first; n_pieces is the
    best one's; round_trip tells if decoding it gives the text back, and round_trips of each of the N best. Whole texts, one pass, no shuffle; the
    vocabulary is broadcast and does not grow with the input. Null and empty texts have one segmentation without
    pieces. A text with fewer than N segmentations has all it has. Repeated rows, null ids and other columns do no
    harm. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(pieces)
    given = docs.select(F.col(text_col).cast("string").alias("_text"), F.col(id_col).cast("long").alias("_id"))
    schema = "n_pieces int, scores array<double>, digests array<string>, round_trip boolean, round_trips array<boolean>" + ", ids array<array<int>>" * with_ids + ", _id long"
    out = given.mapInArrow(_encoded(shared, nbest, with_ids), schema)
    return out.select(F.col("_id").alias("doc_id"), "n_pieces", "scores", "digests", "round_trip", "round_trips", *["ids"] * with_ids)


def decoded(encoded: DataFrame, pieces: Pieces, ids_col: str = "ids") -> DataFrame:
    """`encoded` with column text: the text of the ids (an array of int); null stays null."""
    shared = encoded.sparkSession.sparkContext.broadcast(pieces)

    @F.pandas_udf("string")
    def texts(column):
        m = Segmenter(shared.value, 1)
        return column.map(lambda ids: None if ids is None else m.decode(list(ids)))

    return encoded.withColumn("text", texts(F.col(ids_col)))


def default_model(spark: SparkSession, folder: str | None = None) -> Pieces:
    """The public 32k piece model; its folder is a parameter, else the one that comes with the tokenizer files."""
    return Pieces.load(f"{(folder or '/opt/tokenizers').rstrip('/')}/piece_bpe_32k.model")
