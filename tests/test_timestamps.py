import itertools
from datetime import datetime, timezone

import numpy as np
import pytest

from folioworks.operators.timestamps import _emit, _steps, choose_readings, decide, with_readings, zone_abbreviations

ABBR = zone_abbreviations(["America/New_York", "Europe/Berlin", "Asia/Kolkata"])


def us(*a):
    return int(datetime(*a, tzinfo=timezone.utc).timestamp()) * 1_000_000


CASES = [
    ("2024-01-02T03:04:05Z", None, None, [us(2024, 1, 2, 3, 4, 5)]),
    ("2024-01-02 03:04:05.1234567+02:00", None, None, [us(2024, 1, 2, 1, 4, 5) + 123456]),
    ("20240102T030405Z", None, None, [us(2024, 1, 2, 3, 4, 5)]),
    ("01/02/2024", "Europe/Berlin", "MDY", [us(2024, 1, 1, 23)]),
    ("01/02/24", "Europe/Berlin", "DMY", [us(2024, 1, 31, 23)]),
    ("13/02/2024", "Europe/Berlin", "MDY", []),
    ("01/02/2024", "UTC", None, [us(2024, 1, 2), us(2024, 2, 1)]),
    ("2024-02-30", "UTC", "MDY", []),
    ("2024-01-02", None, None, []),
    ("2024-01-02[Asia/Kolkata]", None, None, []),
    ("2024-01-02T00:00:00[Asia/Kolkata]", None, None, [us(2024, 1, 1, 18, 30)]),
    ("2024-01-02T00:00:00[No/Where]", "UTC", "MDY", []),
    ("2024-03-10 02:30", "America/New_York", "MDY", []),
    ("2024-11-03 01:30", "America/New_York", "MDY", [us(2024, 11, 3, 5, 30), us(2024, 11, 3, 6, 30)]),
    ("2024-11-03 01:30:00 EST", "America/New_York", "MDY", [us(2024, 11, 3, 6, 30)]),
    ("2024-11-03 01:30:00 XYZ", "America/New_York", "MDY", []),
    ("Jan 5, 2024, 12:15 a.m.", "UTC", "MDY", [us(2024, 1, 5, 0, 15)]),
    ("Jan 5, 2024 13:15 pm", "UTC", "MDY", []),
    ("1er août 2023", "UTC", "DMY", [us(2023, 8, 1)]),
    ("20 de abril de 2018", "UTC", "DMY", [us(2018, 4, 20)]),
    ("Tue, 14 Feb 2023 07:43:14 +1100", None, None, [us(2023, 2, 13, 20, 43, 14)]),
    ("1700000000", None, None, [1700000000_000000]),
    ("1700000000123", None, None, [1700000000_123000]),
    ("1700000000123456789", None, None, [1700000000_123456]),
    ("0", None, None, []),
    ("1989-12-31T23:59:59Z", None, None, []),
    ("9999-12-31T23:59:59Z", None, None, []),
    (None, "UTC", "MDY", []),
    ("", "UTC", "MDY", []),
    ("soon " * 5000, "UTC", "MDY", []),
]


@pytest.fixture(scope="module")
def read(spark):
    df = spark.createDataFrame([(i, v, z, o) for i, (v, z, o, _) in enumerate(CASES)], "i int, v string, z string, o string")
    return {r.i: sorted(x.micros for x in r.readings) for r in with_readings(df, "v", "z", "o", ABBR).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_readings(read, i):
    assert read[i] == sorted(CASES[i][3]), CASES[i]


def test_tree_decides_as_brute_force():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 5, 6):
        m = rng.integers(0, 5, (n, 4)).astype(float)
        m[rng.random((n, 4)) < 0.2] = np.nan
        steps = _steps(m, 4.0, 1.0, 0) if n > 1 else []
        cost = lambda p: sum(steps[i][p[i], p[i + 1]] for i in range(n - 1))  # noqa: E731, B023
        for a, b in itertools.product(range(4), range(4)):
            if n == 1:
                continue
            best = min(cost(p) for p in itertools.product(range(4), repeat=n) if p[0] == a and p[-1] == b)
            assert cost(decide(steps, a, b)) == pytest.approx(best)
    assert _emit(np.array([[np.nan] * 4])).sum() == 0


def test_blocks_do_not_change_the_choice(spark):
    rows = [(k, f"{(k % 12) + 1:02d}/{(k * 7) % 28 + 1:02d}/2024") for k in range(1, 300)] + [(500, "25/12/2024"), (None, "01/02/2024")]
    df = with_readings(spark.createDataFrame(rows, "k long, v string").selectExpr("k", "v", "'UTC' z", "CAST(NULL AS STRING) o", "'s' src"), "v", "z", "o", ABBR)
    out = []
    for rows_of_block, coalesce in ((7, "false"), (7, "true"), (1, "false"), (1000, "true")):
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
        out.append(sorted(map(tuple, choose_readings(df, ["src"], "k", block_rows=rows_of_block).select("k", "utc_micros").collect()), key=repr))
    assert out[0] == out[1] == out[2] == out[3] and len(out[0]) == len(rows)
    assert choose_readings(df.limit(0), ["src"], "k").count() == 0
