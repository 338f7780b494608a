"""Mixed timestamp formats and time zones into one UTC instant.

Every value is expanded, inside Catalyst, into the array of all its valid readings: month-first and day-first for
numeric dates, the earlier and the later instant of a local time that a clock change repeats, one unit for a bare number.
A Viterbi pass over each source's records in order then picks one reading per value; it pays for switching between
month-first and day-first and for going back in time. Where the source declares its date order, other orders are no readings.

The pass is exact at any size: the rows are sorted over all tasks by range, so that a hot source is many tasks' work however its keys lie,
and cut by rank into blocks. Each block is reduced to one min-plus matrix by a tree product, the blocks of a source in one task to
one matrix more, those are chained, and then runs, blocks and rows are decided between their fixed ends.

Defined results: null, empty, unreadable, impossible and out-of-range values have no reading and no instant; a value with a
zone or offset of its own uses it, else the source's zone, and with neither it has no reading; abbreviations count only
if the zones of the zone table agree on one offset; skipped local times have no reading, repeated ones have two.
"""

from __future__ import annotations

import zoneinfo
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioworks.operators.packed_fields import lit_trim
from folioworks.session import materialize

# Month names by number, in the languages of the sources (full names and English abbreviations).
MONTH_NAMES = {
    1: "january jan januar janvier enero gennaio janeiro januari",
    2: "february feb februar février fevrier febrero febbraio fevereiro februari",
    3: "march mar märz maerz mars marzo março marco maart",
    4: "april apr avril abril aprile",
    5: "may mai mayo maggio maio mei",
    6: "june jun juni juin junio giugno junho",
    7: "july jul juli juillet julio luglio julho",
    8: "august aug août aout agosto augustus",
    9: "september sep sept septembre septiembre settembre setembro",
    10: "october oct oktober octobre octubre ottobre outubro",
    11: "november nov novembre noviembre novembro",
    12: "december dec dezember décembre decembre diciembre dicembre dezembro",
}
#: Instants outside [RANGE_FROM, RANGE_TO) are no readings.
RANGE_FROM = datetime(1990, 1, 1, tzinfo=timezone.utc)
RANGE_TO = datetime(2036, 1, 1, tzinfo=timezone.utc)
DAY_US = 86_400_000_000
STATES = ("MDY-early", "MDY-late", "DMY-early", "DMY-late")
READING = "array<struct<style: string, fold: int, micros: bigint>>"

_SEP = "\u0001"
_LETTERS = r"\p{L}"
_DATE = (
    r"(?:(\d{4})([-/.])(\d{1,2})\2(\d{1,2})"  # 1 year, 3 month, 4 day
    r"|(\d{1,2})([-/.])(\d{1,2})\6(\d{4}|\d{2})"  # 5, 7 day or month, 8 year
    rf"|(\d{{1,2}})(?:er|st|nd|rd|th|\.)?[-\s]+(?:de\s+)?({_LETTERS}{{3,12}})\.?[-\s]+(?:de\s+)?(\d{{4}})"  # 9 day, 10 name, 11 year
    rf"|({_LETTERS}{{3,12}})\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}}))"  # 12 name, 13 day, 14 year
)
_TIME = r"(?:(?:T|,?\s+)(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,12}))?)?(?:\s*([ap])\.?m\.?)?"  # 15 h, 16 m, 17 s, 18 fraction, 19 a or p
_ZONE = r"\s*(Z|[+-]\d{2}(?::?\d{2})?|[A-Za-z]{2,5})?\s*(?:\[([A-Za-z0-9_/+-]+)\])?)?"  # 20 zone or offset, 21 zone name
_COMPACT = r"(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})(Z|[+-]\d{2}:?\d{2})?"  # 22 .. 28
VALUE = rf"(?i)^(?:(?:{_LETTERS}{{2,9}}\.?,\s+)?{_DATE}{_TIME}{_ZONE}|{_COMPACT})$"
_GROUPS = 28


def zone_abbreviations(zones: list[str]) -> dict[str, int]:
    """Offset in seconds of every abbreviation the zones use, for those on which all of them agree."""
    seen: dict[str, set[int]] = {"UTC": {0}, "GMT": {0}, "UT": {0}}
    for z in zones:
        try:
            info = zoneinfo.ZoneInfo(z)
        except (zoneinfo.ZoneInfoNotFoundError, ValueError):
            continue
        at = RANGE_FROM
        while at < RANGE_TO:
            local = at.astimezone(info)
            name = local.tzname() or ""
            if name.isalpha():
                seen.setdefault(name.upper(), set()).add(int(local.utcoffset().total_seconds()))
            at += timedelta(days=10)
    return {k: next(iter(v)) for k, v in sorted(seen.items()) if len(v) == 1}


def _lookup(key: Column, pairs: dict[str, int]) -> Column:
    """The number of a key in a small fixed table, else null. Two constant arrays keep the generated code short."""
    keys, values = F.array(*[F.lit(k) for k in pairs]), F.array(*[F.lit(v) for v in pairs.values()])
    return F.when(key.isNotNull(), F.get(values, (F.array_position(keys, key) - 1).cast("int")))


def _micros(ts: datetime) -> int:
    return int(ts.timestamp()) * 1_000_000


def _wall(utc_us: Column, zone: Column) -> Column:
    return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(utc_us), zone))


def with_readings(df: DataFrame, value_col: str, zone_col: str, order_col: str, abbreviations: dict[str, int]) -> DataFrame:
    """Add ``readings``: all valid readings of ``value_col`` given the source's zone and date order (MDY, DMY or null)."""
    m = lambda i: F.nullif(F.get(F.col("__ts_g"), F.lit(i)), F.lit(""))
    num = lambda c: c.try_cast("int")
    text = lit_trim(F.col(f"`{value_col}`"))
    df = df.withColumn("__ts_t", text)
    joined = F.regexp_replace(F.col("__ts_t"), VALUE, _SEP.join(f"${i}" for i in range(1, _GROUPS + 1)))
    # Element 0 is unused so that elements count like groups.
    df = df.withColumn("__ts_g", F.when(F.length("__ts_t").between(6, 100) & ~F.col("__ts_t").rlike("^[0-9]+$"), F.split(F.concat(F.lit(_SEP), joined), _SEP)))
    df = df.withColumn("__ts_ok", F.coalesce(F.size("__ts_g") == _GROUPS + 1, F.lit(False)))
    month_by_name = {n: k for k, names in MONTH_NAMES.items() for n in names.split()}
    name = F.lower(F.coalesce(m(10), m(12)))
    named = _lookup(name, month_by_name)
    year = num(F.coalesce(m(1), m(8), m(11), m(14), m(22)))
    df = df.withColumns(
        {
            "__ts_y": F.when(F.col("__ts_ok"), F.when(F.length(m(8)) == 2, year + 2000).otherwise(year)),
            "__ts_a": num(m(5)),
            "__ts_b": num(m(7)),
            "__ts_mo": F.coalesce(num(m(3)), num(m(23)), named),
            "__ts_d": num(F.coalesce(m(4), m(24), m(9), m(13))),
            "__ts_h": num(F.coalesce(m(15), m(25))),
            "__ts_mi": num(F.coalesce(m(16), m(26))),
            "__ts_s": num(F.coalesce(m(17), m(27))),
            "__ts_f": F.rpad(F.substring(m(18), 1, 6), 6, "0").try_cast("int"),
            "__ts_ap": F.lower(m(19)),
            "__ts_z": F.upper(F.coalesce(m(20), m(28))),
            "__ts_zn": m(21),
        }
    )
    hour, ap = F.coalesce(F.col("__ts_h"), F.lit(0)), F.col("__ts_ap")
    h24 = F.when(ap.isNull(), hour).when(hour.between(1, 12), hour % 12 + F.when(ap == "p", 12).otherwise(0))
    mi, s = F.coalesce(F.col("__ts_mi"), F.lit(0)), F.coalesce(F.col("__ts_s"), F.lit(0))
    clock = F.when(
        h24.between(0, 23) & mi.between(0, 59) & s.between(0, 59),
        (h24 * 3600 + mi * 60 + s).cast("long") * 1_000_000 + F.coalesce(F.col("__ts_f"), F.lit(0)),
    )
    z = F.col("__ts_z")
    signed = F.regexp_replace(z, "[^0-9]", "")
    numeric = F.when(
        z.rlike("^[+-]"),
        F.when(z.startswith("-"), -1).otherwise(1) * (num(F.substring(signed, 1, 2)) * 3600 + F.coalesce(num(F.nullif(F.substring(signed, 3, 2), F.lit(""))), F.lit(0)) * 60),
    )
    offset = F.when(z.isNull(), F.lit(None).cast("int")).when(z == "Z", F.lit(0)).when(z.rlike("^[+-]"), numeric).otherwise(_lookup(z, abbreviations))
    known = F.array(*[F.lit(x) for x in sorted(zoneinfo.available_timezones())])
    df = df.withColumns(
        {
            "__ts_clock": clock,
            "__ts_off": offset,
            # A zone that is written but unknown leaves no zone at all, not the source's.
            "__ts_zone": F.when(z.isNotNull(), F.lit(None).cast("string"))
            .when(F.col("__ts_zn").isNotNull(), F.when(F.array_contains(known, F.col("__ts_zn")), F.col("__ts_zn")))
            .otherwise(F.col(f"`{zone_col}`")),
        }
    )

    def local(month: Column, day: Column) -> Column:
        first = F.make_date(F.col("__ts_y"), month, F.lit(1))
        ok = F.col("__ts_ok") & F.col("__ts_y").between(1, 9999) & month.between(1, 12) & (day >= 1)
        return F.when(ok, F.when(day <= F.dayofmonth(F.last_day(first)), (F.unix_date(first) + day - 1).cast("long") * DAY_US + F.col("__ts_clock")))

    a, b, order = F.col("__ts_a"), F.col("__ts_b"), F.col(f"`{order_col}`")
    df = df.withColumns(
        {
            "__ts_l0": local(F.col("__ts_mo"), F.col("__ts_d")),
            "__ts_l1": F.when(a.isNotNull() & F.coalesce(order == "MDY", F.lit(True)), local(a, b)),
            "__ts_l2": F.when(a.isNotNull() & F.coalesce(order == "DMY", F.lit(True)), local(b, a)),
        }
    )
    zone, off = F.col("__ts_zone"), F.col("__ts_off")

    def around(loc: Column, days: int) -> Column:
        at = loc + days * DAY_US
        return loc - (_wall(at, zone) - at)

    # The zone's offsets a day before and a day after; they differ only around a clock change.
    for k in ("0", "1", "2"):
        loc = F.col(f"__ts_l{k}")
        df = df.withColumn(f"__ts_e{k}", F.when(off.isNotNull(), loc - off.cast("long") * 1_000_000).when(zone.isNotNull() & loc.isNotNull(), around(loc, -1)))
        df = df.withColumn(f"__ts_x{k}", F.when(off.isNull() & zone.isNotNull() & loc.isNotNull(), around(loc, 1)))

    lo, hi = _micros(RANGE_FROM), _micros(RANGE_TO)
    in_range = lambda u: (u >= lo) & (u < hi)

    empty = F.array().cast(READING)

    def read(k: str, style: str) -> Column:
        early, late, loc = F.col(f"__ts_e{k}"), F.col(f"__ts_x{k}"), F.col(f"__ts_l{k}")
        # With one offset on both sides the instant is sure; else each must show the written wall clock.
        steady = late.isNull() | (early == late)
        one = lambda u, f: F.struct(F.lit(style).alias("style"), F.lit(f).alias("fold"), u.alias("micros"))
        ok_e = early.isNotNull() & in_range(early) & F.when(steady, F.lit(True)).otherwise(_wall(early, zone) == loc)
        ok_l = ~steady & in_range(late) & F.when(steady, F.lit(False)).otherwise(_wall(late, zone) == loc)
        both = F.array(one(early, 0), one(late, 1)).cast(READING)
        return F.when(ok_e & ok_l, both).when(ok_e, F.array(one(early, 0)).cast(READING)).when(ok_l, F.array(one(late, 1)).cast(READING)).otherwise(empty)

    # The ranges of the units do not overlap: a bare number has one unit or none.
    df = df.withColumn("__ts_n", F.when(F.col("__ts_t").rlike(r"^\d{1,19}$"), F.col("__ts_t").try_cast("bigint")))
    n = F.col("__ts_n")
    bare_us = (
        F.when((n >= lo // 1_000_000) & (n < hi // 1_000_000), n * 1_000_000)
        .when((n >= lo // 1000) & (n < hi // 1000), n * 1000)
        .when(in_range(n), n)
        .when((n >= lo * 1000) & (n < hi * 1000), F.expr("__ts_n div 1000"))
    )
    bare = F.when(bare_us.isNotNull(), F.array(F.struct(F.lit("bare").alias("style"), F.lit(0).alias("fold"), bare_us.alias("micros"))).cast(READING)).otherwise(empty)
    df = df.withColumn(
        "readings",
        F.when(F.col("__ts_n").isNotNull(), bare)
        .when(~F.col("__ts_ok"), empty)
        .when(F.col("__ts_a").isNotNull(), F.concat(F.when(F.col("__ts_l1").isNotNull(), read("1", "MDY")).otherwise(empty), F.when(F.col("__ts_l2").isNotNull(), read("2", "DMY")).otherwise(empty)))
        .otherwise(F.coalesce(read("0", "plain"), empty)),
    )
    return df.drop(*[c for c in df.columns if c.startswith("__ts_")])


# ---- Viterbi over blocks, in the min-plus semiring ----

_BIG = 1e6


def _min_plus(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return (left[..., :, :, None] + right[..., None, :, :]).min(axis=-2)


def _steps(m: np.ndarray, switch_cost: float, back_cost: float, tolerance_us: int) -> np.ndarray:
    """Cost matrices of the steps between neighbouring rows; ``m`` holds each row's instant by state, NaN for none."""
    order = np.array([0, 0, 1, 1])
    cost = np.where(order[:, None] != order[None, :], switch_cost, 0.0)[None, :, :]
    back = m[1:, None, :] < m[:-1, :, None] - tolerance_us  # NaN compares false
    return cost + back_cost * back + _emit(m)[1:, None, :]


def _emit(m: np.ndarray) -> np.ndarray:
    """A state without a reading is out of the question where another state has one."""
    none = np.isnan(m)
    return np.where(none & ~none.all(axis=1, keepdims=True), _BIG, 0.0)


def _tree(steps: np.ndarray) -> list[np.ndarray]:
    """Levels of products of neighbouring matrices; an odd last one moves up alone."""
    levels = [steps]
    while len(levels[-1]) > 1:
        x = levels[-1]
        half = len(x) // 2
        up = _min_plus(x[0 : 2 * half : 2], x[1 : 2 * half : 2])
        levels.append(np.concatenate([up, x[2 * half :]]))
    return levels


def decide(steps: np.ndarray, first: int, last: int) -> np.ndarray:
    """The cheapest states before, between and behind the steps, of which the first and the last are fixed."""
    if not len(steps):
        return np.array([first])
    levels = _tree(steps)
    ends = np.array([first, last])
    for x in reversed(levels[:-1]):
        half = len(x) // 2
        a, c = ends[:-1][:half], ends[1:][:half]
        mid = (x[0 : 2 * half : 2][np.arange(half), a, :] + x[1 : 2 * half : 2][np.arange(half), :, c]).argmin(axis=1)
        new = np.empty(len(x) + 1, dtype=int)
        new[0 : 2 * half : 2], new[1 : 2 * half : 2], new[2 * half] = a, mid, ends[half]
        if len(x) > 2 * half:
            new[2 * half + 1] = ends[half + 1]
        ends = new
    return ends


#: The matrix of a single row: its first state is its last.
_STAY = np.where(np.eye(4) > 0, 0.0, 4 * _BIG)


def _reduced(steps: np.ndarray) -> np.ndarray:
    return _tree(steps)[-1][0] if len(steps) else _STAY


def _joined(mats: np.ndarray, firsts: np.ndarray, lasts: np.ndarray, costs: tuple[float, float, int]) -> np.ndarray:
    """The steps through a row of blocks: each block's matrix, and between two blocks the step from the last row of one to the first row of the next."""
    out = np.empty((2 * len(mats) - 1, 4, 4))
    out[0::2] = mats
    for i in range(len(mats) - 1):
        out[2 * i + 1] = _steps(np.stack([lasts[i], firsts[i + 1]]), *costs)[0]
    return out


def _column(pdf: pd.DataFrame, name: str, shape: tuple[int, ...]) -> np.ndarray:
    return np.stack([np.asarray(x, dtype="float64").reshape(shape) for x in pdf[name]])


def choose_readings(
    df: DataFrame, source_cols: list[str], key_col: str, switch_cost: float = 4.0, back_cost: float = 1.0, tolerance_us: int = DAY_US, block_rows: int = 65_536
) -> DataFrame:
    """Pick one reading per row by Viterbi over each source's rows in the order of ``key_col``.

    ``df`` has the source columns, the whole-number key, and ``readings``. The result has the source columns, the key,
    ``utc_micros`` and ``style`` of the chosen reading, and ``n_instants``, the number of distinct instants that can be read.
    Rows with a null key or source form groups of their own and are kept; rows without any reading have nulls. Rows of one key are
    taken in the order of their instants. A block holds at most ``block_rows`` rows, whatever the keys, so that no task ever holds a whole source.
    """
    spark_cols = [F.col(f"`{c}`") for c in source_cols]
    def at(order: str, place: int) -> Column:
        """The first or last (earlier or later) instant that can be read in this date order."""
        fits = F.filter("readings", lambda r: r.style.isin("plain", "bare", order))
        return F.try_element_at(F.transform(fits, lambda r: r.micros), F.lit(place))

    slim = df.select(
        *[c.cast("string").alias(f"s{i}") for i, c in enumerate(spark_cols)],
        F.col(f"`{key_col}`").cast("long").alias("k"),
        *[at(o, place).alias(f"{name}_{o}") for o in ("MDY", "DMY") for name, place in (("e", 1), ("l", -1))],
        F.size(F.array_distinct(F.transform("readings", lambda r: r.micros))).alias("n_instants"),
    )
    # Sorting samples the rows first; written once, they are not parsed twice.
    slim = materialize(slim, "readings")
    src = [f"s{i}" for i in range(len(source_cols))]
    cols = ["e_MDY", "l_MDY", "e_DMY", "l_DMY"]
    costs = (switch_cost, back_cost, tolerance_us)
    src_schema = ", ".join(f"{s} string" for s in src) + ", keyless boolean"
    groups = [*src, "keyless"]

    def instants(pdf: pd.DataFrame) -> np.ndarray:
        return pdf[cols].to_numpy(dtype="float64")

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Number the blocks of a task's sorted rows; behind each block its matrix, and behind each source the matrix of all its blocks here."""
        task, number, parts, have, held, source = TaskContext.get().partitionId(), 0, [], 0, [], None
        no_mat = {"mat": None, "first_us": None, "last_us": None, "kind": 0}

        def close_block() -> Iterator[pd.DataFrame]:
            nonlocal number, parts, have
            if not have:
                return
            rows = pd.concat(parts, ignore_index=True) if len(parts) > 1 else parts[0]
            m = instants(rows)
            mat = _reduced(_steps(m, *costs)) if len(m) > 1 else _STAY
            held.append((mat, m[0], m[-1]))
            yield rows.assign(run=task, block=number, **no_mat)
            yield summary(rows, 1, number, mat, m[0], m[-1])
            number, parts, have = number + 1, [], 0

        def close_source() -> Iterator[pd.DataFrame]:
            nonlocal held
            if held:
                mats, first, last = (np.stack(x) for x in zip(*held))
                yield summary(example, 2, -1, _reduced(_joined(mats, first, last, costs)), first[0], last[-1])
            held = []

        def summary(like: pd.DataFrame, kind: int, block: int, mat: np.ndarray, first: np.ndarray, last: np.ndarray) -> pd.DataFrame:
            row = {**{c: like[c].iloc[0] for c in groups}, "run": task, "block": block, "mat": mat.ravel(), "first_us": first, "last_us": last, "kind": kind}
            return pd.DataFrame([row]).reindex(columns=[*names, "run", "block", "mat", "first_us", "last_us", "kind"])

        example = None
        for pdf in frames:
            names = list(pdf.columns)
            here = pdf[groups].astype("string").fillna("\x00")
            change = (here != here.shift()).any(axis=1).to_numpy()
            change[0] = True
            starts = [*np.flatnonzero(change).tolist(), len(pdf)]
            for a, z in zip(starts, starts[1:]):
                own = tuple(here.iloc[a])
                if own != source:
                    yield from close_block()
                    yield from close_source()
                    source, example = own, pdf.iloc[a : a + 1]
                while a < z:
                    take = min(z - a, block_rows - have)
                    parts.append(pdf.iloc[a : a + take])
                    a, have = a + take, have + take
                    if have == block_rows:
                        yield from close_block()
        yield from close_block()
        yield from close_source()

    # Equal rows are interchangeable, so a task that is run again numbers its blocks alike.
    ordered = slim.withColumn("keyless", F.col("k").isNull()).repartitionByRange(*groups, "k", *cols).sortWithinPartitions(*groups, "k", *cols)
    fields = f"{', '.join(f'{s} string' for s in src)}, k long, {', '.join(f'{c} long' for c in cols)}, n_instants int, keyless boolean"
    ordered = ordered.select(*src, "k", *cols, "n_instants", "keyless")
    ordered = materialize(ordered.mapInPandas(cut, f"{fields}, run long, block long, mat array<double>, first_us array<double>, last_us array<double>, kind int"), "readings-blocks")

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        """The runs of a source, one a task of the sort: their first and last states on the cheapest way."""
        pdf = pdf.sort_values("run", kind="stable")
        mats, first, last = _column(pdf, "mat", (4, 4)), _column(pdf, "first_us", (4,)), _column(pdf, "last_us", (4,))
        steps = _joined(mats, first, last, costs)
        whole = _emit(first[:1])[0][:, None] + _reduced(steps)
        states = decide(steps, *np.unravel_index(int(whole.argmin()), whole.shape))
        return pd.DataFrame({**{c: pdf[c] for c in groups}, "run": pdf["run"], "first_state": states[0::2], "last_state": states[1::2]})

    def inner(pdf: pd.DataFrame, fixed: pd.DataFrame) -> pd.DataFrame:
        """The blocks of a run between its fixed ends."""
        pdf = pdf.sort_values("block", kind="stable")
        if not len(pdf):
            return pd.DataFrame({c: [] for c in [*groups, "run", "block", "first_state", "last_state"]})
        steps = _joined(_column(pdf, "mat", (4, 4)), _column(pdf, "first_us", (4,)), _column(pdf, "last_us", (4,)), costs)
        states = decide(steps, int(fixed["first_state"].iloc[0]), int(fixed["last_state"].iloc[0]))
        return pd.DataFrame({**{c: pdf[c] for c in groups}, "run": pdf["run"], "block": pdf["block"], "first_state": states[0::2], "last_state": states[1::2]})

    def final(pdf: pd.DataFrame, fixed: pd.DataFrame) -> pd.DataFrame:
        out_cols = [*src, "k", "utc_micros", "style", "n_instants"]
        if not len(pdf):
            return pd.DataFrame({c: [] for c in out_cols})
        pdf = pdf.sort_values(["k", *cols], kind="stable", na_position="first")
        m = instants(pdf)
        steps = _steps(m, *costs) if len(m) > 1 else np.zeros((0, 4, 4))
        states = decide(steps, int(fixed["first_state"].iloc[0]), int(fixed["last_state"].iloc[0]))
        value = np.stack([pdf[c].astype("Int64").to_numpy(dtype="object", na_value=None) for c in cols])[states, np.arange(len(m))]
        return pd.DataFrame(
            {**{s: pdf[s].to_numpy() for s in src}, "k": pdf["k"].to_numpy(), "utc_micros": pd.array(value, dtype="Int64"), "style": np.array(STATES, dtype=object)[states], "n_instants": pdf["n_instants"].to_numpy()}
        )

    runs, blocks, rows = (ordered.where(F.col("kind") == i) for i in (2, 1, 0))
    runs = runs.select(*groups, "run", "mat", "first_us", "last_us").groupBy(*groups).applyInPandas(chain, f"{src_schema}, run long, first_state int, last_state int")
    blocks = blocks.select(*groups, "run", "block", "mat", "first_us", "last_us").groupBy(*groups, "run").cogroup(runs.groupBy(*groups, "run"))
    fixed = blocks.applyInPandas(inner, f"{src_schema}, run long, block long, first_state int, last_state int")
    keys = [*groups, "run", "block"]
    decided = rows.select(*keys, "k", *cols, "n_instants").groupBy(*keys).cogroup(fixed.groupBy(*keys)).applyInPandas(final, f"{', '.join(f'{s} string' for s in src)}, k long, utc_micros long, style string, n_instants int")
    return decided.select(*[F.col(s).alias(c) for s, c in zip(src, source_cols)], F.col("k").alias(key_col), "utc_micros", F.when(F.col("utc_micros").isNotNull(), F.col("style")).alias("style"), "n_instants")
