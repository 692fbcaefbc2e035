"""Chat exports as turns: (conversation, title, place, role, text, ts, model, extra). Formats drift, so all is optional."""

from __future__ import annotations

import contextlib
import io
import os
import re
import zipfile
from collections.abc import Iterator

from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import is_noise, slug, to_timestamp

# Objects and mixed arrays are kept as JSON text and parsed where their shape is known.
_MESSAGE = "struct<author: struct<role: string>, create_time: string, content: struct<content_type: string, text: string, parts: array<string>>, metadata: struct<model_slug: string>>"
GRAPH_EXPORT = f"id string, conversation_id string, title string, create_time string, default_model_slug string, mapping map<string, struct<message: {_MESSAGE}>>"
LIST_EXPORT = (
    "uuid string, name string, title string, created_at string, chat_messages array<struct<sender: string, role: string, text: string, created_at: string, content: array<struct<type: string, text: string, input: string, content: string>>>>"
)
ACTIVITY_EXPORT = "title string, time string, subtitles array<struct<name: string>>"


_OUTSIDE, _INSIDE = re.compile(r'["\[\]{},]'), re.compile(r'["\\]')


def stream_array(chunks: Iterator[str]) -> Iterator[str]:
    """The top-level elements of one JSON array, from pieces of its text, holding one element at a time.

    Expressions find the next mark that matters, so plain text between marks is passed at their speed.
    """
    depth, quoted, held, skip = 0, False, [], 0
    for chunk in chunks:
        start, at = 0, skip
        skip = 0
        while m := (_INSIDE if quoted else _OUTSIDE).search(chunk, at):
            i, at, c = m.start(), m.end(), m.group()
            if c == "\\":
                at += 1  # what it escapes, which may begin the next piece
            elif c == '"':
                quoted = not quoted
            elif c in "[{":
                depth += 1
                if depth == 1:
                    start = at
            elif c in "]}" or depth == 1:
                depth -= c in "]}"
                if depth <= 1 and (c == "," or depth == 0):
                    held.append(chunk[start:i])
                    if element := "".join(held).strip():
                        yield element
                    if depth == 0:
                        return
                    held, start = [], at
        skip = max(0, at - len(chunk))
        if depth:
            held.append(chunk[start:])


SHARDS, ASSETS = re.compile(r"conversations-\d+\.json$"), re.compile(r"conversation_asset_file_names\.json$")


class Piece(InputPartition):
    """A file, or a member of an archive."""

    def __init__(self, path: str, member: str | None):
        super().__init__(path)
        self.path, self.member = path, member


class _ElementReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    @staticmethod
    def _open(path: str):
        system, place = FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + os.path.abspath(path))
        return system, place

    def partitions(self) -> list[Piece]:
        system, place = self._open(self.path)
        info = system.get_file_info(place)
        files = [info] if info.type == FileType.File else system.get_file_info(FileSelector(place, recursive=True))
        prefix, out = self.path[: len(self.path) - len(place)] if self.path.endswith(place) else "", []
        for f in sorted((f for f in files if f.type == FileType.File and not f.base_name.startswith(("_", "."))), key=lambda f: f.path):
            if f.path.endswith(".zip"):
                with system.open_input_file(f.path) as raw, zipfile.ZipFile(raw) as z:
                    out += [Piece(prefix + f.path, m) for m in sorted(z.namelist()) if SHARDS.search(m) or ASSETS.search(m)]
            else:
                out.append(Piece(prefix + f.path, None))
        return out

    def read(self, piece: Piece) -> Iterator[tuple]:
        system, place = self._open(piece.path)
        with contextlib.ExitStack() as stack:
            if piece.member is None:
                raw = stack.enter_context(system.open_input_stream(place))
            else:
                archive = stack.enter_context(zipfile.ZipFile(stack.enter_context(system.open_input_file(place))))
                raw = stack.enter_context(archive.open(piece.member))
            text = io.TextIOWrapper(raw, encoding="utf-8", errors="replace")
            if piece.member and ASSETS.search(piece.member):
                yield piece.path, piece.member, text.read()
                return
            for element in stream_array(iter(lambda: text.read(1 << 20), "")):
                yield piece.path, piece.member, element


class ExportElements(DataSource):
    """(file, member, element): the elements of the JSON arrays in files and zipped shards under a path, as JSON text.

    A task reads one file, or one shard of an archive, a megabyte at a time and holds one element, so neither the size
    of an array nor that of an archive is bounded. Any store that Arrow's file systems open will do.
    """

    @classmethod
    def name(cls) -> str:
        return "export_elements"

    def schema(self) -> str:
        return "file string, member string, element string"

    def reader(self, schema) -> DataSourceReader:
        return _ElementReader(self.options["path"])


def elements(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(ExportElements)
    return spark.read.format("export_elements").load(path)


def read_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Elements of the JSON arrays in the files under a path; bad elements become nulls, not failures."""
    return elements(spark, path).where("member is null").select(F.from_json("element", schema).alias("c")).select("c.*")


def read_zip(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(conversations, asset names) of sharded export archives: a task for each shard."""
    rows = elements(spark, path).where("member is not null")
    assets = F.rlike("member", F.lit(ASSETS.pattern))
    talks = rows.where(~assets).select(F.from_json("element", GRAPH_EXPORT).alias("c")).select("c.*")
    names = rows.where(assets).select(F.explode(F.from_json("element", "map<string, string>")).alias("dat", "name"))
    return talks, names


def _part_text(part: Column, day: Column) -> Column:
    """Text of a part: a string, an object with a text, or a marker for an image."""
    kind, pointer = F.get_json_object(part, "$.content_type"), F.get_json_object(part, "$.asset_pointer")
    is_object = F.startswith(F.ltrim(part), F.lit("{")) & (kind.isNotNull() | pointer.isNotNull() | F.get_json_object(part, "$.text").isNotNull())
    image = F.coalesce(F.contains(kind, F.lit("image")), F.lit(False)) | pointer.isNotNull()
    ident = F.element_at(F.split(F.coalesce(pointer, F.lit("")), "//"), -1)
    marker = F.concat(F.lit("[image · made "), F.coalesce(day, F.lit("")), F.lit(" · id "), ident, F.lit("]"))
    return F.when(is_object & image, marker).when(is_object, F.get_json_object(part, "$.text")).otherwise(part)


def graph_turns(talks: DataFrame, default_time: Column) -> DataFrame:
    """Turns of exports whose messages form a graph: by time; system messages, and tools' output other than code, drop."""
    rows = talks.select(F.coalesce("conversation_id", "id", F.md5(F.to_json(F.struct("title", "create_time")))).alias("conversation"), F.coalesce(F.nullif("title", F.lit("")), F.lit("untitled")).alias("title"), F.col("default_model_slug").alias("slug"), F.explode(F.map_values("mapping")).alias("node"))
    m = F.col("node.message")
    kind = F.coalesce(m["content"]["content_type"], F.lit("text"))
    code = kind.isin("code", "execution_output")
    ts = to_timestamp(m["create_time"], default_time)
    day = F.date_format(ts, "yyyy-MM-dd")
    parts = F.filter(F.transform(m["content"]["parts"], lambda p: _part_text(p, day)), lambda p: F.trim(F.coalesce(p, F.lit(""))) != "")
    text = F.trim(F.when(code, F.coalesce(m["content"]["text"], F.lit(""))).otherwise(F.coalesce(F.array_join(parts, " "), F.lit(""))))
    role = m["author"]["role"]
    extra = F.when(kind == "code", F.array(F.lit("code"))).when(kind == "execution_output", F.array(F.lit("code"), F.lit("output"))).when(F.contains(text, F.lit("[image · made ")), F.array(F.lit("image"))).otherwise(F.array().cast("array<string>"))
    rows = rows.where(role.isin("user", "assistant") | ((role == "tool") & code)).select("conversation", "title", F.when(role == "user", "user").otherwise("agent").alias("role"), text.alias("text"), ts.alias("ts"), F.coalesce(m["create_time"].try_cast("double"), F.lit(0.0)).alias("o"), F.coalesce(m["metadata"]["model_slug"], "slug", F.lit("gpt-imported")).alias("model"), extra.alias("extra"))
    from pyspark.sql import Window

    return rows.where("text <> ''").withColumn("place", F.row_number().over(Window.partitionBy("conversation").orderBy("o", "role", "text")) - 1).drop("o")


def list_turns(talks: DataFrame, default_time: Column) -> DataFrame:
    """Turns of exports with a list of messages: the text, else its content blocks."""
    rows = talks.select(F.coalesce("uuid", F.md5(F.to_json(F.struct("name", "created_at")))).alias("conversation"), F.coalesce(F.nullif("name", F.lit("")), F.nullif("title", F.lit("")), F.lit("untitled")).alias("title"), F.posexplode("chat_messages").alias("place", "m"))
    m = F.col("m")
    sender = F.coalesce(F.nullif(m["sender"], F.lit("")), m["role"])

    def block(b):
        return F.when(F.coalesce(b["text"], F.lit("")) != "", b["text"]).when(F.contains(b["type"], F.lit("image")), F.lit("[image]")).when(b["type"].isin("tool_use", "tool_result"), F.coalesce(b["input"], b["content"]))

    blocks = F.array_compact(F.transform(m["content"], block))
    text = F.trim(F.coalesce(F.nullif(F.trim(m["text"]), F.lit("")), F.array_join(blocks, " "), F.lit("")))
    tags = F.when(F.exists(m["content"], lambda b: b["type"].isin("tool_use", "tool_result")) & (F.coalesce(F.trim(m["text"]), F.lit("")) == ""), F.array(F.lit("code"))).otherwise(F.array().cast("array<string>"))
    out = rows.where(sender.isin("human", "user", "assistant")).select("conversation", "title", "place", F.when(sender == "assistant", "agent").otherwise("user").alias("role"), text.alias("text"), to_timestamp(m["created_at"], default_time).alias("ts"), F.lit(None).cast("string").alias("model"), F.coalesce(tags, F.array().cast("array<string>")).alias("extra"))
    return out.where("text <> ''")


def activity_turns(items: DataFrame, default_time: Column) -> DataFrame:
    """Turns of an activity log: each prompt and its first reply, one conversation for each UTC day."""
    rows = items.where(F.startswith("title", F.lit("Prompted"))).select(F.btrim(F.trim(F.substring(F.col("title"), F.lit(9), F.length("title"))), F.lit('"')).alias("prompt"), to_timestamp(F.col("time"), default_time).alias("ts"), F.try_element_at(F.filter(F.transform("subtitles", lambda s: s["name"]), lambda n: (n != "") & ~F.startswith(n, F.lit("Prompted"))), F.lit(1)).alias("reply"))
    both = F.array_compact(F.array(F.struct(F.lit("user").alias("role"), F.col("prompt").alias("text")), F.when(F.col("reply").isNotNull(), F.struct(F.lit("agent").alias("role"), F.col("reply").alias("text")))))
    day = F.date_format("ts", "yyyy-MM-dd")
    rows = rows.select(day.alias("day"), "ts", "prompt", F.posexplode(both).alias("o", "t"))
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("day").orderBy("ts", "prompt", "o")) - 1
    return rows.select(F.concat(F.lit("activity-"), "day").alias("conversation"), F.concat(F.lit("activity "), "day").alias("title"), place.alias("place"), "t.role", "t.text", "ts", F.lit(None).cast("string").alias("model"), F.array().cast("array<string>").alias("extra"))


def to_nodes(turns: DataFrame, source: str, preview: int = 8000) -> DataFrame:
    """Nodes of imported turns without noise: a session for each conversation, ids from session and place, chained."""
    from pyspark.sql import Window

    session = F.concat(F.lit(f"import-{source}-"), slug(F.col("title")), F.lit("-"), F.substring(F.sha2("conversation", 256), 1, 8))
    rows = turns.where(~is_noise(F.col("text"))).withColumn("session", session)
    w = Window.partitionBy("session").orderBy("place")
    rows = rows.withColumn("n", F.row_number().over(w)).withColumn("id", F.substring(F.sha2(F.concat_ws("|", "session", F.col("n").cast("string")), 256), 1, 12))
    whole = F.when(F.length("text") > preview, F.col("text"))
    return rows.select("id", "session", F.lit("conversation_turn").alias("kind"), F.col("role").alias("speaker"), F.substring("text", 1, 2000).alias("query"), F.substring("text", 1, preview).alias("output_preview"), whole.alias("episodic_full"), F.lag("id").over(w).alias("parent"), "ts", F.coalesce("model", F.lit(f"{source}-imported")).alias("model"), F.array_union(F.array(F.lit("import"), F.lit(source)), "extra").alias("tags"), "n")


def export_sizes(turns: DataFrame) -> DataFrame:
    """(conversation, turns, chars): full text sizes for an estimate of cost."""
    return turns.groupBy("conversation").agg(F.count(F.lit(1)).alias("turns"), F.sum(F.length("text")).alias("chars"))
