import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from folioworks.operators.packed_fields import explode_packed_values, with_packed_values

CASES = [
    (None, []),
    ("", []),
    (" , ,", []),
    ("a, b;c|d\te\r\nf，g、h", ["a", "b", "c", "d", "e", "f", "g", "h"]),
    ("a || b", ["a", "b"]),
    ("Either/Or / slow · fast • last", ["Either/Or", "slow", "fast", "last"]),
    ('"a, b", c', ["a, b", "c"]),
    ('"The ""Quiet"" House"; x', ['The "Quiet" House', "x"]),
    ("'up, up', rock 'n' roll, Winter's End", ["up, up", "rock 'n' roll", "Winter's End"]),
    ("Salt\\, Sand, Fire \\| Ice", ["Salt, Sand", "Fire | Ice"]),
    ("Fish &amp; Ships;Tom & Ines; &#233;t&eacute;", ["Fish &amp; Ships", "Tom & Ines", "&#233;t&eacute;"]),
    ('["a", "b, c", null, 3, "caf\\u00e9"]', ["a", "b, c", "3", "café"]),
    ("['a', 'b, c']", ["a", "b, c"]),
    ('{a,"b; c","The \\"q\\" h"}', ["a", "b; c", 'The "q" h']),
    ('"a b" "c d"', ["a b", "c d"]),
    ("#one #two, #three", ["one", "two", "three"]),
    ("\u00a0x\u3000", ["x"]),
    ("x\ue000y, \ue0013\ue002", ["x\ue000y", "\ue0013\ue002"]),
    ("a, a, A", ["a", "a", "A"]),
]


@pytest.mark.parametrize("value,want", CASES)
def test_values(spark, value, want):
    df = spark.createDataFrame([(1, value)], "k long, v string")
    assert with_packed_values(df, "v").first()["items"] == want


def test_rows_keep_places_and_repeats(spark):
    df = spark.createDataFrame([(1, "b, ,a", "x"), (1, "b, ,a", "y"), (None, "c", "z"), (2, None, "w")], "k long, v string, item_pos string")
    got = sorted(explode_packed_values(df, "k", "v").collect(), key=repr)
    assert [tuple(r) for r in got] == [(1, 1, "b"), (1, 1, "b"), (1, 2, "a"), (1, 2, "a"), (None, 1, "c")]
    assert explode_packed_values(df.limit(0), "k", "v").count() == 0


def test_very_long_field(spark):
    value = ", ".join(f'"v{i}, w"' if i % 2 else f"v{i}" for i in range(20_000))
    df = spark.createDataFrame([(1, value)], "k long, v string")
    rows = explode_packed_values(df, "k", "v")
    assert rows.count() == 20_000 and rows.where("item = 'v19999, w' AND item_pos = 20000").count() == 1


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet='ab ,;|/"\'\\&é\ue000\ue001\ue002#', min_size=1, max_size=8), min_size=1, max_size=5))
def test_quoting_round_trip(spark, values):
    packed = ", ".join('"' + v.replace("\\", "\\\\").replace('"', '""') + '"' for v in values)
    df = spark.createDataFrame([(1, packed)], "k long, v string")
    want = [x for x in ((v.strip(" ")[1:] if v.strip(" ").startswith("#") else v).strip(" ") for v in values) if x]
    assert with_packed_values(df, "v").first()["items"] == want


def test_very_long_spans(spark):
    rows = [(1, '"' + "x" * 1_000_000 + ', y", b'), (2, '"a"", b'), (3, "'" + "it''s " * 100_000 + "', c"), (4, '"' + "x," * 100_000)]
    got = {r.k: (r.n, r.w) for r in explode_packed_values(spark.createDataFrame(rows, "k long, v string"), "k", "v").groupBy("k").agg(F.count("*").alias("n"), F.max(F.length("item")).alias("w")).collect()}
    assert got == {1: (2, 1_000_003), 2: (2, 2), 3: (2, 499_999), 4: (100_000, 2)}
