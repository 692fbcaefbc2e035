"""Point-in-time features against a plain count for each sale, with a client that has most rows."""

import math
import random
import zlib
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from mnemotide.llm import pit_features
from mnemotide.llm.pit_features import point_in_time_features

CLICKS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string, start long, latest string"
SALES = "sale_id long, client_id long, status string, total double, sold_at timestamp_ntz, arrived_at timestamp_ntz, priority int, bin long, at long"
LINES = "sale_id long, line_no int, item_id long, vendor_id long, quantity int, amount double, discount double, flag string, shipped_at timestamp_ntz, _part int"
T0 = datetime(2024, 1, 1)
DAY, HOUR = timedelta(days=1), timedelta(hours=1)


def _tables(n, seed=1):
    rng = random.Random(seed)

    def time():
        return rng.choice([None, T0, *[T0 + timedelta(seconds=rng.randrange(40 * 86400), microseconds=rng.choice([0, 1, 999_999])) for _ in range(20)]])

    def late(t):
        return rng.choice([None, T0]) if t is None or rng.random() < 0.05 else t + timedelta(hours=rng.choice([0, 1, 30, 200, 700]))

    def client():
        return rng.choice([7, 7, 7, 1, 2, 3, None])

    clicks = [(rng.choice([None, i, i]), t := time(), late(t), client(), rng.choice(["purchase", "view", None]), rng.choice([None, 1.005, -3.2, math.nan, math.inf, 9.99]), "{}", 0, "") for i in range(n)]
    clicks += clicks[::9]
    sales = [(i, client(), "open", rng.choice([None, 10.25, 0.0, math.nan]), t := time(), late(t), 1, 0, 0) for i in range(n // 2)]
    sales += [(None, 1, "open", 1.0, T0, T0, 1, 0, 0), (3, 7, "open", 2.0, T0 + 9 * DAY, T0 + 9 * DAY, 1, 0, 0)]
    lines = [(rng.choice([None, -1, 3, *range(0, n // 2, 3)]), 1, rng.choice([None, 1, 2, 3, i]), 1, 1, rng.choice([None, 3.335, -1.0]), 0.0, "kept", time(), 0) for i in range(2 * n)]
    return clicks, sales, lines + lines[::7]


def _cents(x):
    return 0 if x is None or not math.isfinite(x) else math.floor(100 * x + 0.5)


def _brute(clicks, sales, lines, windows=(2, 14)):
    out, delay = [], timedelta(minutes=240)
    clicks = [c for c in {str(c): c for c in clicks}.values() if c[1] and c[2]]
    good = [s for s in sales if s[1] is not None and s[4]]
    for sid, who, _, _, sold, *_ in good:
        t = sold + timedelta(seconds=zlib.crc32(str(sid).encode()) % 259200 if sid is not None else 0)
        label = any(s[1] == who and t < s[4] <= t + 7 * DAY for s in good)
        for d in windows:
            c = [x for x in clicks if x[3] == who and t - d * DAY < x[1] <= t and x[2] + delay <= t]
            s = [x for x in good if x[1] == who and t - d * DAY < x[4] <= t and x[5] and x[5] + delay <= t]
            held = [x for y in s for x in lines if x[0] is not None and x[0] == y[0] and x[8] and x[8] <= t]
            last = max(c, key=lambda x: (x[1], x[0] is not None, x[0] or 0))[0] if c else None
            out.append((sid, d, round((t - datetime(1970, 1, 1)) / timedelta(microseconds=1)), label, len(c), sum(x[4] == "purchase" for x in c), sum(_cents(x[5]) for x in c), last, len(s), sum(_cents(x[3]) for x in s),
                        len(held), len({x[2] for x in held} - {None}), sum(_cents(x[5]) for x in held)))
    return sorted(map(str, out))


def _frames(spark, clicks, sales, lines):
    return spark.createDataFrame(clicks, CLICKS), spark.createDataFrame(sales, SALES), spark.createDataFrame(lines, LINES)


def _found(df):
    return sorted(str(tuple(r)) for r in df.collect())


@pytest.mark.parametrize("per_bin", [1, 32])
def test_features_equal_a_count_for_each_sale(spark, monkeypatch, per_bin):
    monkeypatch.setattr(pit_features, "PER_BIN", per_bin)
    tables = _tables(240, per_bin)
    assert _found(point_in_time_features(*_frames(spark, *tables))) == _brute(*tables)


def test_timestamps_with_a_zone_other_windows_and_another_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        tables = _tables(60)
        clicks, sales, lines = _frames(spark, *tables)
        assert _found(point_in_time_features(clicks, sales, lines, (1, 3, 30))) == _brute(*tables, (1, 3, 30))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    zoned = clicks.withColumns({c: F.col(c).cast("timestamp") for c in ("ts", "arrived_at")})
    assert _found(point_in_time_features(zoned, sales, lines)) == _brute(*tables)


def test_empty_tables(spark):
    clicks, sales, lines = _tables(40)
    assert _found(point_in_time_features(*_frames(spark, [], sales, []))) == _brute([], sales, [])
    assert _found(point_in_time_features(*_frames(spark, clicks, [], lines))) == []
