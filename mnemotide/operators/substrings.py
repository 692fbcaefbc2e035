"""Exact substring search over an inverted index of three-character grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch

SIZE = 3


def grams(text: Column) -> Column:
    """Distinct runs of three characters of a text in lower case; none for shorter texts and null."""
    low = F.lower(F.coalesce(text, F.lit("")))
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - SIZE + 1, F.lit(1))), lambda i: F.substring(low, i, F.lit(SIZE)))
    return F.array_distinct(F.filter(runs, lambda g: F.length(g) == SIZE))


class GramIndex:
    """Postings (gram, id) of the texts of rows, in buckets by gram and sorted within them, and the number of rows of each gram.

    `words_in` finds the rows that hold a word: it reads the postings of the word's two rarest grams, intersects them, and
    verifies what is left on the texts, so texts without those grams are not read into the search. A gram of a third of all
    rows is used only for words that have no rarer one. Words shorter than three characters have no grams and cannot be asked.
    """

    def __init__(self, rows: DataFrame, id_col: str, texts: list[str], scratch: Scratch, buckets: int = 64):
        self.texts = [F.lower(F.coalesce(F.col(c), F.lit(""))) for c in texts]
        self.rows, self.id_col, self.scratch = rows, id_col, scratch
        found = F.array_distinct(F.flatten(F.array(*[grams(F.col(c)) for c in texts])))
        postings = rows.select(F.explode(found).alias("gram"), F.col(id_col).alias("id")).withColumn("bucket", F.pmod(F.hash("gram"), F.lit(buckets)))
        self.postings = scratch.save(postings.repartition("bucket", F.pmod(F.hash("id"), F.lit(8))).sortWithinPartitions("bucket", "gram"), partition_by="bucket")
        self.counts = scratch.save(self.postings.groupBy("bucket", "gram").agg(F.count(F.lit(1)).alias("rows")))

    def candidates(self, words: DataFrame, word: str = "word", used: int = 2) -> DataFrame:
        """(word, id): rows that hold the `used` rarest grams of each distinct word, a superset of those that hold the word."""
        asked = words.select(F.lower(word).alias("word")).where(F.length("word") >= SIZE).distinct()
        each = asked.select("word", F.explode(grams(F.col("word"))).alias("gram")).join(self.counts, "gram", "left")
        rank = F.row_number().over(Window.partitionBy("word").orderBy(F.coalesce("rows", F.lit(0)), "gram"))
        rare = self.scratch.save(each.withColumn("r", rank).where(F.col("r") <= used))
        needed = rare.groupBy("word").agg(F.count(F.lit(1)).alias("needed"), F.count("rows").alias("known")).where("needed = known").select("word", "needed")
        met = rare.select("word", "gram", "bucket").join(needed, "word").join(self.postings, ["bucket", "gram"])
        return met.groupBy("word", "id", "needed").agg(F.count(F.lit(1)).alias("n")).where("n = needed").select("word", "id")

    def words_in(self, words: DataFrame, word: str = "word") -> DataFrame:
        """(word, columns of the rows): every row one of whose texts holds the word, in any case."""
        met = self.candidates(words, word).withColumnRenamed("id", "_id").join(self.rows, F.col("_id") == F.col(self.id_col)).drop("_id")
        holds = F.lit(False)
        for t in self.texts:
            holds = holds | F.contains(t, F.col("word"))
        return met.where(holds)


def holders(rows: DataFrame, words: DataFrame, id_col: str, texts: list[str], scratch: Scratch, few: int = 64, word: str = "word") -> DataFrame:
    """(word, columns of the rows) like `GramIndex.words_in`, for words that are asked once.

    Up to `few` distinct words are looked for in each text as it is read, and nothing is written; postings of all grams of
    all texts are many times the texts. More words go through an index.
    """
    asked = scratch.save(words.select(F.lower(word).alias("word")).where(F.length("word") >= SIZE).distinct())
    if asked.count() > few:
        return GramIndex(rows, id_col, texts, scratch).words_in(asked)
    holds = F.lit(False)
    for c in texts:
        holds = holds | F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.col("word"))
    return rows.join(F.broadcast(asked), holds).select("word", *rows.columns)
