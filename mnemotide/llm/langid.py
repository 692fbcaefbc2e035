"""Language ID by Bayesian evidence fusion: text likelihood, declared markup language, address suffix, host priors."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from .features import bounded_sample, trigram_counts

BITS = 13
_LETTER = re.compile(r"[^\W\d_]")
_CODE = re.compile(rb"[0-9@]")

# Country suffixes of hosts and the language they speak for.
SUFFIX_LANGUAGE = {"at": "de", "ar": "es", "au": "en", "ca": "en", "cl": "es", "co": "es", "de": "de", "es": "es", "fr": "fr", "ie": "en", "mx": "es", "nz": "en", "pe": "es", "uk": "en", "us": "en"}


@dataclass
class Model:
    languages: list[str]
    log_p: np.ndarray  # a row of log probabilities of trigram buckets for each language
    floor: float  # mean log likelihood of a trigram below which a text is in no language that was learned


def fit(rows: np.ndarray, languages: list[str], smoothing: float = 0.5, most: float = 2000.0, margin: float = 2.5) -> Model:
    """Multinomial models of trigram counts; a long text counts as `most` trigrams, so that it does not outweigh others.

    `floor` lies `margin` below the lowest percentile of the training texts' mean log likelihoods.
    """
    names = sorted(set(languages))
    counts = np.zeros((len(names), 1 << BITS))
    sizes = rows.sum(axis=1)
    for row, n, lang in zip(rows, sizes, languages, strict=True):
        counts[names.index(lang)] += row * min(1.0, most / max(n, 1.0))
    log_p = np.log((counts + smoothing) / (counts + smoothing).sum(axis=1, keepdims=True)) if names else counts
    means = [(row @ log_p.T).max() / n for row, n in zip(rows, sizes, strict=True) if n >= 20]
    return Model(names, log_p, float(np.percentile(means, 1) - margin) if means else -np.inf)


_BLANKS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def counts_of(text: str) -> np.ndarray:
    """Trigrams of the words in lower case; words with digits or at-signs say nothing, other marks count as blanks."""
    data = text.lower().encode("utf-8", "surrogatepass")
    if _CODE.search(data):
        data = b" ".join(w for w in data.split() if not _CODE.search(w))
    return trigram_counts(data.translate(_BLANKS), BITS)


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [counts_of(t) for t in batch.column(0).to_pylist()]
        at = [np.flatnonzero(r) for r in rows]
        cells = [pa.array([i.astype(np.int16) for i in at], pa.list_(pa.int16())), pa.array([r[i].astype(np.int32) for r, i in zip(rows, at, strict=True)], pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays([*cells, batch.column(1)], names=["at", "n", "lang"])


def fit_on(docs: DataFrame, sample_rows: int = 2000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from the whole texts of at most `sample_rows` documents with a known language (lowest hash of the id).
    Of rows that repeat an id the one with the smallest text, then language, counts."""
    chosen = bounded_sample(docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id")).distinct(), sample_rows, "id")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    once = rows.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min(F.struct("text", "lang")).alias("x"))
    found = once.select("x.text", "x.lang").mapInArrow(_sparse, "at array<short>, n array<int>, lang string").collect()
    counts = np.zeros((len(found), 1 << BITS))
    for i, r in enumerate(found):
        counts[i, r["at"]] = r["n"]
    return fit(counts, [r["lang"] for r in found])


def _likelihoods(shared, evidence: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                texts = [t or "" for t in part.column(0).to_pylist()]
                counts = np.stack([counts_of(t) for t in texts]).astype(np.float64)
                n = counts.sum(axis=1)
                mean = counts @ m.log_p.T / np.maximum(n, 1)[:, None]
                # trigrams overlap and repeat, so a text counts as `evidence` independent ones at most
                like = mean * np.minimum(n, evidence)[:, None]
                known = np.array([bool(_LETTER.search(t)) for t in texts]) & ((mean.max(axis=1) >= m.floor) | (n < 20))
                like = np.where(known[:, None], like - like.max(axis=1, keepdims=True), 0.0)
                yield pa.RecordBatch.from_arrays([pa.array(list(like), pa.list_(pa.float64())), pa.array(known), *part.columns[1:]], names=["_like", "_known", *part.schema.names[1:]])

    return run


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def declared_in(html: Column) -> Column:
    """The primary language that a page's html element declares, or null."""
    found = F.lower(F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?\s*([A-Za-z]{2,3})\b", 1))
    return F.when(found != "", found)


def identify(
    rows: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", host: Column | None = None, declared: Column | None = None, keep: tuple[str, ...] = (), evidence: float = 60.0, smoothing: float = 20.0, trust_declared: float = 0.8, trust_suffix: float = 0.6, least: float = 0.5
) -> DataFrame:
    """(doc_id, language, probability, accepted, columns in `keep`), one row for each row.

    The posterior is the product of the text's likelihood, the chance of the declared markup language
    (`trust_declared` if it agrees), that of the host's country suffix (`trust_suffix`), and the host's prior. The
    prior comes from grouped sums of all rows' text posteriors at four levels, each smoothed by the one above with
    `smoothing` rows: host, its last two labels, its last label, everything. A row's own share is taken out of its
    host's sums, so it does not vote for itself.

    The text likelihoods are written once (a narrow table without texts); sums are combined before the shuffle, so
    a host with a third of all rows is safe. `accepted` is false where the text has no letters, fits none of the
    learned languages, or the probability is under `least`. Null and empty texts rest on the other evidence but are
    not accepted. Texts of fewer than 20 trigrams cannot tell whether they fit, so they need not. Very long texts are read
    whole. Ties go to the first language by name. A null host counts as one host without labels. An empty
    table gives an empty result, as rows without any learned language have a null language.
    """
    spark = rows.sparkSession
    names = model.languages
    if not names:
        return rows.select(F.col(id_col).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("language"), F.lit(0.0).alias("probability"), F.lit(False).alias("accepted"), *[F.col(c) for c in keep])
    shared = spark.sparkContext.broadcast(model)
    place = F.lit("") if host is None else F.coalesce(host, F.lit(""))
    claim = F.lit(None).cast("string") if declared is None else declared
    given = rows.select(F.col(text_col).cast("string").alias("_text"), F.col(id_col).cast("long").alias("_id"), place.alias("_host"), claim.alias("_declared"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)])
    kept = [(f"_k{i}", rows.schema[c].dataType.simpleString()) for i, c in enumerate(keep)]
    schema = ", ".join(["_like array<double>, _known boolean, _id long, _host string, _declared string", *[f"{n} {t}" for n, t in kept]])
    texts = Scratch(spark, "langid").save(given.mapInArrow(_likelihoods(shared, evidence), schema))

    total = F.aggregate("_like", F.lit(0.0), lambda s, x: s + F.exp(x))
    share = [F.when(F.col("_known"), F.exp(F.col("_like")[i]) / total).otherwise(0.0) for i in range(len(names))]
    labels = F.split("_host", r"\.")
    texts = texts.withColumn("_suffix", F.element_at(labels, -1)).withColumn("_domain", F.concat_ws(".", F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2)))
    hosts = texts.groupBy("_host", "_domain", "_suffix").agg(*[F.sum(s).alias(f"h{i}") for i, s in enumerate(share)])

    def summed(df, keys, old, new):
        return df.groupBy(*keys).agg(*[F.sum(f"{old}{i}").alias(f"{new}{i}") for i in range(len(names))])

    domains = summed(hosts, ["_domain", "_suffix"], "h", "d")
    suffixes = summed(domains, ["_suffix"], "d", "s")
    every = summed(suffixes, [], "s", "g").first()
    whole = sum(every[i] or 0.0 for i in range(len(names)))
    top = [((every[i] or 0.0) + 1.0) / (whole + len(names)) for i in range(len(names))]
    priors = hosts.join(domains, ["_domain", "_suffix"]).join(suffixes, "_suffix").drop("_domain", "_suffix")
    joined = texts.join(priors, "_host")

    weight = [F.lit(p) for p in top]
    for level in "sdh":
        own = [F.greatest(F.col(f"{level}{i}") - s, F.lit(0.0)) for i, s in enumerate(share)]
        n = sum(own[1:], own[0])
        weight = [(o + smoothing * w) / (n + smoothing) for o, w in zip(own, weight, strict=True)]
        joined = joined.withColumns({f"_w{level}{i}": w for i, w in enumerate(weight)})
        weight = [F.col(f"_w{level}{i}") for i in range(len(names))]
    spoken = F.create_map(*[F.lit(x) for pair in SUFFIX_LANGUAGE.items() for x in pair])[F.col("_suffix")]
    spoken = F.coalesce(spoken, F.lit(""))
    other = max(1, len(names) - 1)
    logs = []
    for i, name in enumerate(names):
        said = F.when(F.col("_declared").isNull() | ~F.col("_declared").isin(names), 1.0).when(F.col("_declared") == name, trust_declared).otherwise((1 - trust_declared) / other)
        local = F.when(~spoken.isin(names), 1.0).when(spoken == name, trust_suffix).otherwise((1 - trust_suffix) / other)
        logs.append(F.col("_like")[i] + F.log(weight[i]) + F.log(said) + F.log(local))
    scored = joined.withColumn("_post", F.array(*logs)).withColumn("_best", F.array_max("_post"))
    scored = scored.withColumn("_p", 1.0 / F.aggregate("_post", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("_best"))))
    language = F.array(*[F.lit(n) for n in names])[(F.array_position("_post", F.col("_best")) - 1).cast("int")]
    return scored.select(F.col("_id").alias("doc_id"), language.alias("language"), F.col("_p").alias("probability"), (F.col("_known") & (F.col("_p") >= least)).alias("accepted"), *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)])
