"""Point-in-time features: history as validity segments, and probes that meet their one segment by equal bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.scans import running, running_ranges
from ..scratch import Scratch

SECOND, MINUTE, DAY = 1_000_000, 60_000_000, 86_400_000_000
PER_BIN = 32  # segments that a bin of a client has on average


def micros(df: DataFrame, col: str) -> Column:
    """Microseconds since 1970 of a timestamp; one without a zone counts as UTC, whatever the session's zone."""
    c = F.col(col)
    if df.schema[col].dataType.typeName() != "timestamp_ntz":
        return F.unix_micros(c.cast("timestamp"))
    whole = F.unix_date(F.to_date(c)).cast("long") * 86400 + F.hour(c) * 3600 + F.minute(c) * 60
    return whole * SECOND + (F.extract(F.lit("SECOND"), c) * SECOND).cast("long")


def cents(col: str) -> Column:
    """floor(100 x + 0.5) as a whole number; 0 for null and for what no whole number of 64 bits can hold."""
    x = F.col(col).cast("double") * 100 + 0.5
    return F.coalesce(F.when(F.abs(x) < 9e18, F.floor(x)), F.lit(0)).cast("long")


def _width(n: Column, low: Column, high: Column) -> Column:
    """Bits of a bin's width in microseconds, so that a client's span holds about n / PER_BIN bins; one bin for few rows."""
    bits = F.ceil(F.log2((high - low + 1).cast("double") * PER_BIN / n)).cast("int")
    return F.when(n <= 2 * PER_BIN, F.lit(50)).otherwise(F.greatest(bits, F.lit(10)))


class History:
    """Values of each key that are constant between changes, from signed changes ("deltas").

    deltas: (key, at, a column for each of `sums`, and `latest`, a struct, where `with_latest`). Deltas of the same key and
    time coalesce; running sums (and the running maximum of `latest`) give the value from each time to the next one, `lead`.
    Segments are split at the edges of bins of time, whose width follows from how many deltas the key has, so that each probe
    meets its segment by an equi-join on (key, bin). A key with most deltas is many ranges and then many bins.
    """

    def __init__(self, deltas: DataFrame, key: str, sums: list[str], scratch: Scratch, with_latest: bool = False):
        self.key = key
        tie = [F.xxhash64("at", *sums).alias("tie")] if not with_latest else [F.xxhash64("at", "latest").alias("tie")]
        dealt = deltas.withColumn("_tie", tie[0])
        parts = scratch.save(dealt.repartitionByRange(key, "at", "_tie").drop("_tie").withColumn("_part", F.spark_partition_id()))
        ranges = parts.groupBy(key, "_part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("low"), F.max("at").alias("high"))
        spans = ranges.groupBy(key).agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.count(F.lit(1)).alias("ranges"))
        self.spans = scratch.save(spans.select(key, _width(F.col("n"), F.col("low"), F.col("high")).alias("width"), "ranges"))
        # a key in several ranges crosses an edge between two of them, so there are fewer of these than ranges
        several = F.broadcast(self.spans.where("ranges > 1").select(F.col(key).alias("_key"), F.col("width").alias("_width")))

        latest = [F.max("latest").alias("latest")] if with_latest else []
        merged = parts.repartition(key, "_part").groupBy(key, "_part", "at").agg(*[F.sum(c).alias(c) for c in sums], *latest, F.count(F.lit(1)).alias("_n"))
        own = {"_n": F.sum("_n").over(_within(key)), "_low": F.min("at").over(_within(key)), "_high": F.max("at").over(_within(key))}
        values = running_ranges(
            parts, [key], ["at"], scratch, {c: F.col(c) for c in sums}, {"latest": F.col("latest")} if with_latest else {}, {}, {"end": F.col("at")}, rows=merged.withColumns(own)
        ).where("end > at")
        values = values.join(several, F.col(key) == F.col("_key"), "left").withColumn("width", F.coalesce("_width", _width(F.col("_n"), F.col("_low"), F.col("_high"))))
        bins = F.expr("sequence(shiftright(at, width), shiftright(end - 1, width))")
        split = values.withColumn("bin", F.explode(bins)).withColumns({"_from": F.greatest("at", F.expr("shiftleft(bin, width)")), "_to": F.least("end", F.expr("shiftleft(bin + 1, width)"))})
        self.segments = split.select(F.col(key).alias("_key"), F.col("bin").alias("_bin"), "_from", "_to", *sums, *(["latest"] if with_latest else []))

    def probe(self, probes: DataFrame, t: str = "t_us") -> DataFrame:
        """`probes` with the values of the segment that holds their time; null where no segment does."""
        bins = self.spans.select(F.col(self.key), "width")
        placed = probes.join(bins, self.key, "left").withColumn("bin", F.expr(f"shiftright({t}, width)")).drop("width")
        same = (F.col(self.key) == F.col("_key")) & (F.col("bin") == F.col("_bin"))
        return placed.join(self.segments, same & (F.col("_from") <= F.col(t)) & (F.col(t) < F.col("_to")), "left").drop("_key", "_bin", "bin", "_from", "_to")


def _within(key: str):
    return Window.partitionBy(key, "_part")


def _row(at: Column, columns: list[str], **values: Column) -> Column:
    return F.struct(at.alias("at"), *[values.get(c, F.lit(0)).cast("long").alias(c) for c in columns])


def click_deltas(clicks: DataFrame, windows: tuple[int, ...], delay: int) -> tuple[DataFrame, list[str]]:
    """A click counts from its time, or `delay` after it arrived if that is later, until its time is a window's length ago."""
    names = [f"{n}_{d}" for d in windows for n in ("n_clicks", "n_purchases", "click_cents")]
    whole = clicks.select(F.xxhash64(F.lit(1), *clicks.columns).alias("h1"), F.xxhash64(F.lit(2), *clicks.columns).alias("h2"), F.col("client_id").cast("long").alias("client_id"), micros(clicks, "ts").alias("ts"), micros(clicks, "arrived_at").alias("arrived"),
                          F.col("click_id").cast("long").alias("click_id"), F.coalesce(F.col("kind") == "purchase", F.lit(False)).cast("long").alias("bought"), cents("value").alias("cents"))
    rest = ["client_id", "ts", "arrived", "click_id", "bought", "cents"]
    once = whole.where("client_id is not null and ts is not null and arrived is not null").groupBy("h1", "h2").agg(*[F.first(c).alias(c) for c in rest])
    rows = once.withColumn("start", F.greatest("ts", F.col("arrived") + delay)).where(F.col("start") < F.col("ts") + max(windows) * DAY)
    part = {d: F.col("start") < F.col("ts") + d * DAY for d in windows}

    def values(d: int, sign: int) -> dict:
        on = F.when(part[d], sign).otherwise(0)
        return {f"n_clicks_{d}": on, f"n_purchases_{d}": on * F.col("bought"), f"click_cents_{d}": on * F.col("cents")}

    begins = _row(F.col("start"), names, **{k: v for d in windows for k, v in values(d, 1).items()})
    ends = [F.when(part[d], _row(F.col("ts") + d * DAY, names, **values(d, -1))) for d in windows]
    deltas = rows.select("client_id", "start", "ts", "click_id", F.explode(F.array_compact(F.array(begins, *ends))).alias("x"))
    latest = F.when(F.col("x.at") == F.col("start"), F.struct("ts", "click_id"))
    return deltas.select("client_id", "x.at", *[f"x.{n}" for n in names], latest.alias("latest")), names


def sale_deltas(sales: DataFrame, lines: DataFrame, windows: tuple[int, ...], delay: int, ahead: int, scratch: Scratch) -> tuple[DataFrame, list[str]]:
    """Sales and their lines, alike; an item counts once however many of the window's lines have it. `future`: sales in the days to come."""
    names = ["future", *[f"{n}_{d}" for d in windows for n in ("n_sales", "sale_cents", "n_lines", "n_items", "line_cents")]]
    rows = sales.withColumn("start", F.greatest("sold", F.col("arrived") + delay))
    rows = rows.withColumn("start", F.when(F.col("arrived").isNotNull(), F.col("start")))
    part = {d: F.col("start") < F.col("sold") + d * DAY for d in windows}  # null where it never counts

    def values(d: int, sign: int) -> dict:
        on = F.when(part[d], sign).otherwise(0)
        return {f"n_sales_{d}": on, f"sale_cents_{d}": on * F.col("cents")}

    begins = F.when(F.col("start").isNotNull(), _row(F.col("start"), names, **{k: v for d in windows for k, v in values(d, 1).items()}))
    ends = [F.when(part[d], _row(F.col("sold") + d * DAY, names, **values(d, -1))) for d in windows]
    label = [_row(F.col("sold") - ahead, names, future=F.lit(1)), _row(F.col("sold"), names, future=F.lit(-1))]
    own = rows.select("client_id", F.explode(F.array_compact(F.array(*label, begins, *ends))).alias("x"))

    held = lines.select(F.col("sale_id").cast("long").alias("sale_id"), F.col("item_id").cast("long").alias("item_id"), micros(lines, "shipped_at").alias("shipped"), cents("amount").alias("cents")).where("sale_id is not null and shipped is not null")
    met = held.join(rows.where("start is not null").select("sale_id", "client_id", "sold", "start"), "sale_id")
    met = met.select("client_id", "item_id", F.greatest("start", "shipped").alias("start"), "sold", "cents").where(F.col("start") < F.col("sold") + max(windows) * DAY)
    # what earlier lines of the item cover ends a window's length after the latest of their sales: a line adds only what comes after
    seen = running(met.withColumn("tie", F.xxhash64("start", "sold", "cents")), ["client_id", "item_id"], ["start", "tie"], scratch, maxes={"past": F.col("sold")}, before=True)
    out = []
    line_begin, item_at = {}, {}
    for d in windows:
        on = F.when(part[d], 1).otherwise(0)
        begin = F.greatest("start", F.col("past") + d * DAY)
        item_at[d] = F.when(F.col("item_id").isNotNull() & (begin < F.col("sold") + d * DAY), begin)
        line_begin |= {f"n_lines_{d}": on, f"line_cents_{d}": on * F.col("cents"), f"n_items_{d}": F.when(item_at[d] == F.col("start"), 1).otherwise(0)}
        new = F.when(item_at[d].isNotNull(), -1).otherwise(0)
        out.append(F.when(item_at[d] > F.col("start"), _row(item_at[d], names, **{f"n_items_{d}": F.lit(1)})))
        out.append(F.when(part[d], _row(F.col("sold") + d * DAY, names, **{f"n_lines_{d}": -on, f"line_cents_{d}": -on * F.col("cents"), f"n_items_{d}": new})))
    of_lines = seen.select("client_id", F.explode(F.array_compact(F.array(_row(F.col("start"), names, **line_begin), *out))).alias("x"))
    both = own.unionAll(of_lines)
    return both.select("client_id", "x.at", *[f"x.{n}" for n in names]), names


def point_in_time_features(clicks: DataFrame, sales: DataFrame, lines: DataFrame, windows: tuple[int, ...] = (2, 14), delay_minutes: int = 240, label_days: int = 7, offset_seconds: int = 259_200) -> DataFrame:
    """Two or more rows for each sale with a client and a time, one for each window of d days:
    (sale_id, d, t_us, label, n_clicks, n_purchases, click_cents, last_click_id, n_sales, sale_cents, n_lines, n_items, line_cents).

    t is the sale's time and crc32(decimal sale_id) modulo `offset_seconds` seconds (0 for a null id). Counted is what
    happened in (t - d days, t] and had arrived `delay_minutes` before t: the client's clicks (wholly equal rows once) and
    sales, and of these sales the lines shipped by t. label: the client has a sale in (t, t + label_days].

    Rows without a client, a time of their own or one of arrival never count (a sale without arrival still makes a label);
    lines without a sale, or whose sale is absent, neither. Each row of `sales` is a sale, with all lines of its sale_id, also if
    the id repeats. last_click_id: of the latest click, then the largest id; null ids are least. Amounts that are null or no
    number count 0 cents. Empty tables give empty histories: features 0 and null, no sales no rows.
    """
    scratch = Scratch(sales.sparkSession, "pit")
    sold = sales.select(F.col("sale_id").cast("long").alias("sale_id"), F.col("client_id").cast("long").alias("client_id"), micros(sales, "sold_at").alias("sold"), micros(sales, "arrived_at").alias("arrived"), cents("total").alias("cents"))
    sold = sold.where("client_id is not null and sold is not null")
    delay = delay_minutes * MINUTE
    first, clicked = click_deltas(clicks, windows, delay)
    browsing = History(first, "client_id", clicked, scratch, with_latest=True)
    second, bought = sale_deltas(sold, lines, windows, delay, label_days * DAY, scratch)
    buying = History(second, "client_id", bought, scratch)
    offset = F.coalesce(F.pmod(F.crc32(F.col("sale_id").cast("string")), F.lit(offset_seconds)), F.lit(0)) * SECOND
    probes = sold.select("sale_id", "client_id", (F.col("sold") + offset).alias("t_us"))
    met = buying.probe(browsing.probe(probes))

    def of(n: str, d: int) -> Column:
        return F.coalesce(f"{n}_{d}", F.lit(0)).cast("long").alias(n)

    rows = [
        F.struct(
            F.lit(d).cast("int").alias("d"), *[of(n, d) for n in ("n_clicks", "n_purchases", "click_cents")], F.when(F.col("latest.ts") + d * DAY > F.col("t_us"), F.col("latest.click_id")).alias("last_click_id"),
            *[of(n, d) for n in ("n_sales", "sale_cents", "n_lines", "n_items", "line_cents")],
        )
        for d in windows
    ]
    out = met.select("sale_id", "t_us", (F.coalesce("future", F.lit(0)) > 0).alias("label"), F.inline(F.array(*rows)))
    return out.select("sale_id", "d", "t_us", "label", "n_clicks", "n_purchases", "click_cents", "last_click_id", "n_sales", "sale_cents", "n_lines", "n_items", "line_cents")
