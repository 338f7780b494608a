"""Texts into containers of fixed capacity with little room left over, by histogram packing.

Sizes are tokens of a public tokenizer. Only the histogram of sizes, which is bounded by the capacity, reaches the driver:
there, shallow combinations of lengths that fill the window are enumerated, a non-negative least squares problem says how
often to repeat each, the counts are rounded to what the histogram holds, and the rest is packed greedily, longest first.
The plan that results says, for ranges of ranks among the items of one length, which containers they go to. Ranking the
items is distributed and salted, so that a length that a third of all texts share does not end in one task.

Window lengths: n items in a container need n - 1 separators, so an item weighs its tokens plus one separator and the window
is the capacity plus one separator. Windows longer than BINS are cut into BINS steps for the least squares part; an item
then counts as rounded up to whole steps, so that every combination really fits.

Defined results: a null text has no row; an empty text is an item of no tokens; a text larger than a container is cut into
pieces of exactly one container and a rest, all other texts stay whole; specifications without a positive capacity or
with a null in it have no rows; ties are broken by doc_id; a doc_id that stands in several rows is packed several times.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioworks.session import materialize, spread

BINS = 512
DEPTH = 3
#: Iterations of the least squares solver.
STEPS = 600
#: Items of one length and salt that one task ranks, about.
RANK_ROWS = 1_000_000

# The pre-tokenisation pattern of the public byte-level BPE, used where its package is not installed.
BYTE_BPE_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


def tokenizer_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Where the vocabulary file is; any other file of ranks may be given to ``token_counts`` instead."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _encoding(data: bytes):
    import tiktoken

    try:
        from public_tokenizers import PATTERN as pattern
    except ImportError:
        pattern = BYTE_BPE_PATTERN
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}
    return tiktoken.Encoding("folioworks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id and n_tokens of every non-null text. ``vocabulary`` is a rank file; its bytes, under 1 MB, go to the tasks."""
    with open(vocabulary, "rb") as f:
        shared = documents.sparkSession.sparkContext.broadcast(f.read())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoding(shared.value)
        size = enc.encode_to_numpy if hasattr(enc, "encode_to_numpy") else enc.encode_ordinary
        for b in batches:
            sizes = [len(size(t.as_py())) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64())], names=["doc_id", "n_tokens"])

    return spread(documents.select("doc_id", "text").where("text IS NOT NULL")).mapInArrow(count, "doc_id long, n_tokens long")


# ---- the plan, on the driver, from a histogram of at most capacity + 1 lengths ----


def combinations(window: int, depth: int = DEPTH) -> np.ndarray:
    """All multisets of up to ``depth`` (at most 3) lengths that sum to the window; 0 stands for no item."""
    out = [np.array([[window, 0, 0]])]
    if depth > 1:
        a = np.arange((window + 1) // 2, window)
        out.append(np.stack([a, window - a, np.zeros_like(a)], axis=1))
    if depth > 2:
        a, b = np.meshgrid(np.arange(1, window - 1), np.arange(1, window - 1), indexing="ij")
        c = window - a - b
        ok = (a >= b) & (b >= c) & (c >= 1)
        out.append(np.stack([a[ok], b[ok], c[ok]], axis=1))
    return np.concatenate(out)


def least_squares(combos: np.ndarray, histogram: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - histogram|, by accelerated projected gradient on the sparse A."""
    n, real = len(histogram), combos > 0

    def times(x: np.ndarray) -> np.ndarray:
        return np.bincount(combos.ravel(), weights=(x[:, None] * real).ravel(), minlength=n)

    def back(r: np.ndarray) -> np.ndarray:
        return (r[combos] * real).sum(axis=1)

    v = np.ones(len(combos))
    for _ in range(20):
        v = back(times(v))
        norm = np.linalg.norm(v)
        v /= norm
    x, y, t = np.zeros(len(combos)), np.zeros(len(combos)), 1.0
    for _ in range(steps):
        new = np.maximum(0.0, y - back(times(y) - histogram) / norm)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / t2 * (new - x), new, t2
    return x


def make_plan(lengths: np.ndarray, counts: np.ndarray, window: int) -> tuple[np.ndarray, int]:
    """Ranges (length, first rank, end rank, first container, slot), and the number of containers.

    Item number r of a length, for r in the range, goes to container ``first container + r - first rank``.
    """
    order = np.argsort(lengths)
    lengths, counts = lengths[order], counts[order].astype(np.int64)
    width = -(-window // BINS)
    size = window // width
    bins = -(-lengths // width)
    # Items of a bin in falling length: a rank in the bin is a length and a rank in it.
    histogram = np.bincount(np.minimum(bins, size), weights=counts * (bins <= size), minlength=size + 1).astype(np.int64)
    combos = combinations(size)
    present = (histogram[combos] > 0) | (combos == 0)
    combos = combos[present.all(axis=1)]
    left, taken, placed, containers = histogram.copy(), np.zeros(size + 1, dtype=np.int64), [], 0
    if len(combos):
        x = least_squares(combos, histogram.astype(float))
        for k in np.argsort(-x, kind="stable"):
            want = int(round(x[k]))
            if want < 1:
                break
            parts, need = np.unique(combos[k][combos[k] > 0], return_counts=True)
            want = min(want, int((left[parts] // need).min()))
            if want < 1:
                continue
            slot = 0
            for part, times in zip(parts, need):
                for _ in range(times):
                    placed.append((part, taken[part], taken[part] + want, containers, slot))
                    taken[part] += want
                    left[part] -= want
                    slot += 1
            containers += want
    # From ranks in bins to ranks in lengths.
    ranges: list[tuple[int, int, int, int, int]] = []
    used = np.zeros(len(lengths), dtype=np.int64)
    by_bin: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for b in np.unique(bins):
        own = np.flatnonzero(bins == b)[::-1]
        by_bin[int(b)] = (own, np.concatenate([[0], np.cumsum(counts[own])]))
    for part, a, z, first, slot in placed:
        own, edge = by_bin[int(part)]
        i = int(np.searchsorted(edge, a, "right")) - 1
        while a < z:
            end = min(z, int(edge[i + 1]))
            ranges.append((int(lengths[own[i]]), int(a - edge[i]), int(end - edge[i]), int(first), int(slot)))
            used[own[i]] = max(used[own[i]], end - edge[i])
            first, a, i = first + end - a, end, i + 1
    # The rest: the longest item left, then again and again the longest that still fits; each pattern is repeated while it can be.
    rest = counts - used
    while True:
        live = np.flatnonzero(rest > 0)
        if not len(live):
            break
        take: dict[int, int] = {}
        space, top = window, len(live)
        while top > 0:
            top = int(np.searchsorted(lengths[live[:top]], space, "right"))
            if top == 0:
                break
            i = int(live[top - 1])
            n = min(int(rest[i]), space // int(lengths[i])) if lengths[i] else int(rest[i])
            take[i] = n
            space -= n * int(lengths[i])
            top -= 1
        if not take:
            raise ValueError("an item is longer than the window")
        repeat = min(int(rest[i]) // n for i, n in take.items())
        slot = 0
        for i, n in take.items():
            for _ in range(n):
                ranges.append((int(lengths[i]), int(used[i]), int(used[i]) + repeat, containers, slot))
                used[i] += repeat
                slot += 1
            rest[i] -= n * repeat
        containers += repeat
    return np.array(sorted(ranges), dtype=np.int64).reshape(-1, 5), containers


def pack_documents(documents: DataFrame, specs: DataFrame, vocabulary: str) -> DataFrame:
    """One row per document piece and container specification.

    Columns: spec_id, container_id (from 0), slot (place in the container), doc_id, piece_no (from 1), n_pieces,
    first_token (from 0), n_tokens.
    """
    spark = documents.sparkSession
    wanted = [(r[0], r[1], r[2] or 0) for r in specs.select("spec_id", "capacity_tokens", "separator_tokens").where("spec_id IS NOT NULL AND capacity_tokens > 0").distinct().collect()]
    schema = "spec_id long, container_id long, slot long, doc_id long, piece_no long, n_pieces long, first_token long, n_tokens long"
    sizes = materialize(token_counts(documents, vocabulary), "token-counts")
    if not wanted:
        return spark.createDataFrame([], schema)
    spec = F.explode(F.array(*[F.struct(F.lit(s).cast("long").alias("spec_id"), F.lit(c).cast("long").alias("cap"), F.lit(p).cast("long").alias("sep")) for s, c, p in wanted]))
    per_spec = sizes.select("doc_id", "n_tokens", spec.alias("spec")).select("doc_id", "n_tokens", "spec.*")
    n_pieces = F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / F.col("cap"))).cast("long")
    pieces = per_spec.withColumn("n_pieces", n_pieces).withColumn("piece_no", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_pieces"))))
    pieces = pieces.withColumn("first_token", (F.col("piece_no") - 1) * F.col("cap"))
    pieces = pieces.withColumn("piece_tokens", F.least(F.col("n_tokens") - F.col("first_token"), F.col("cap"))).withColumn("length", F.col("piece_tokens") + F.col("sep"))

    salts = int(min(4096, max(8, sizes.count() // RANK_ROWS)))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("spec_id", "length", "salt").count()
    # The histogram, at most capacity + 1 rows a specification.
    totals: dict[int, dict[int, int]] = {}
    for s, length, n in salted.groupBy("spec_id", "length").count().collect():
        totals.setdefault(s, {})[length] = n
    plans = {}
    for s, cap, sep in wanted:
        if s in totals:
            ranges, _ = make_plan(np.array(list(totals[s])), np.array(list(totals[s].values())), cap + sep)
            own, first = np.unique(ranges[:, 0], return_index=True)
            plans[s] = {n: ranges[a:z, 1:] for n, a, z in zip(own.tolist(), first.tolist(), [*first[1:].tolist(), len(ranges)])}
    shared = spark.sparkContext.broadcast(plans)

    # A rank among all items of a length: the rank within the salt, and the counts of the salts before. The join finds the items
    # partitioned as the ranking left them; only the counts move.
    before = Window.partitionBy("spec_id", "length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("spec_id", "length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy("spec_id", "length", "salt").orderBy("doc_id", "piece_no")) - 1
    ranked = salted.withColumn("within", within).join(offsets.hint("merge"), ["spec_id", "length", "salt"])
    ranked = ranked.select("spec_id", "length", (F.col("within") + F.col("offset")).alias("rank"), "doc_id", "piece_no", "n_pieces", "first_token", F.col("piece_tokens").alias("n_tokens"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans = shared.value
        for b in batches:
            s, length, rank = (np.asarray(b.column(i)).astype(np.int64) for i in range(3))
            container, slot = np.empty(b.num_rows, dtype=np.int64), np.empty(b.num_rows, dtype=np.int64)
            groups, inverse = np.unique(np.stack([s, length], axis=1), axis=0, return_inverse=True)
            order = np.argsort(inverse.ravel(), kind="stable")
            edges = np.searchsorted(inverse.ravel()[order], np.arange(len(groups) + 1))
            for g, (gs, gl) in enumerate(groups.tolist()):
                rows = order[edges[g] : edges[g + 1]]
                own, r = plans[gs][gl], rank[rows]
                k = np.searchsorted(own[:, 0], r, "right") - 1
                container[rows], slot[rows] = own[k, 2] + r - own[k, 0], own[k, 3]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(container), pa.array(slot), *[b.column(i) for i in range(3, 8)]], names=["spec_id", "container_id", "slot", "doc_id", "piece_no", "n_pieces", "first_token", "n_tokens"])

    return ranked.mapInArrow(place, schema)


def container_fill(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """Per specification: containers, tokens, room left over, and the fewest containers that any packing could need."""
    used = packed.groupBy("spec_id", "container_id").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("k"))
    joined = used.join(specs.select("spec_id", "capacity_tokens", F.coalesce("separator_tokens", F.lit(0)).alias("sep")).distinct(), "spec_id")
    filled = F.col("t") + (F.col("k") - 1) * F.col("sep")
    return joined.groupBy("spec_id", "capacity_tokens").agg(
        F.count(F.lit(1)).alias("containers"),
        F.sum("t").alias("tokens"),
        F.max(filled).alias("fullest"),
        F.sum(F.col("capacity_tokens") - filled).alias("room_left"),
        (1 - F.sum(F.col("capacity_tokens") - filled) / F.sum("capacity_tokens")).alias("fill"),
    )
