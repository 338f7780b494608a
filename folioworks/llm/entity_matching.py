"""The same works in two tables without a common key.

Attributes become fixed bit vectors of hashed q-grams. Close pairs are found exactly by multi-index Hamming hashing, scored by
a field-weighted mean of Dice values, and the score is turned into a confidence by isotonic calibration against a field
that the score does not use (the texts).

Multi-index Hamming hashing: each 64-bit word of a vector is a chunk. Two vectors within the radius differ in at most as many
chunks as the radius has bits, so the others, at least words - radius of them, are equal. The chunks are dealt into so few
groups that one group must hold KEY_CHUNKS equal ones; the index keys are all subsets of that size within a group. Nothing
within the radius is lost. Each key travels with the vector folded to 64 bits by exclusive or; folding never lengthens a distance,
so pairs whose folds are further apart than the radius are dropped inside the join, before any vector is looked at.

What is compared (always within one part number of a serial):
  A  title and author in one vector, where both rows name an author;
  B  the title, where an author is missing on either side and the sites are equal or one is missing.
The search runs over classes of rows that are equal in what is compared, so copies cost nothing; close classes are then expanded
into rows, the right rows of a large class in blocks of BLOCK_ROWS, so that no task holds all pairs of a stock title.
Keys of chunks that hold hardly any bit are many; they are salted.

Defined results: rows with a null key or without a title have no pair; parts of serials match only under the same number
or side word, which may be misspelt by one edit;
placeholders (anonymous, unknown) count as missing; missing fields have no weight; repeated rows match each for itself.
"""

from __future__ import annotations

import html
import re
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioworks.session import discard, materialize

TITLE_WORDS, AUTHOR_WORDS, TEXT_WORDS, TAG_WORDS = 12, 6, 8, 2  # 64-bit words of the vectors
#: Radius and chunks of a key for title with author, and for the title alone.
BOTH_RADIUS, BOTH_KEY_CHUNKS = 9, 3
TITLE_RADIUS, TITLE_KEY_CHUNKS = 7, 2
#: Keys with fewer bits are salted; rows of the right side that one task expands a class into.
SALTED_BELOW, SALTS = 2, 8
BLOCK_ROWS = 1000
#: Weights of the fields in the score; texts are kept for calibration.
WEIGHTS = {"title": 3.0, "author": 4.0, "site": 4.0, "year": 1.0, "tags": 1.0, "length": 1.0}
#: Overlap of texts from which two texts are the same.
TEXT_SAME = 0.6
#: What is taken as the same work: the least confidence, and the least Dice value of the titles (a pair may agree in all but the title).
CONFIDENT, LEAST_TITLE = 0.5, 0.5

# Remarks behind a title, parts that are works of their own, and placeholders for authors.
_REMARK = re.compile(r"\s*\*+[^*]{1,20}\*+\s*$|[\s\-–—(\[]*\b(?:complete|completed|edited|updated|revised|repost|reposted|final|finished)\b[\s)\]]*$")
_SIDE = re.compile(r"[\s\-–—:,(]*\b(prologue|epilogue|side stor(?:y|ies)|interlude|sequel)\)?\s*$")
# The same words misspelt: one to three words at the end, within one edit of a side word; other words that are as near stay titles.
_SIDE_WORDS = ("prologue", "epilogue", "side story", "side stories", "interlude", "sequel")
_ENDINGS = [re.compile(r"[\s\-–—:,(]*\b([^\W\d_]+(?:[ -][^\W\d_]+){%d})\)?\s*$" % n) for n in range(3)]
_NOT_SIDE = re.compile(r"(?:aside|bide|hide|ride|sire|site|size|slide|snide|tide|wide) stor(?:y|ies)|side store")
_NUMBER = re.compile(
    r"[\s,\-–—:]*(?:(?:\b(?:pt|part|ch|chap|chapter|vol|volume|book|no|nr|teil|partie|parte)\b[\s.]*[#(]?|[#(])\s*(\d{1,4}|[ivx]{1,5})\)?|(?<=[\s,\-–—:])(\d{1,4}))\s*$"
)
_ROMAN = {"i": 1, "v": 5, "x": 10}
PLACEHOLDERS = frozenset(["", "anonymous", "anon", "unknown", "n/a", "na", "none", "null", "-", "--", "?", "author"])
_NO_ALNUM = re.compile(r"[^\w\s]|_")
_TAG = re.compile(r"<[^>]*>")


def fold(text: str | None) -> str:
    text = text or ""
    if text.isascii() and "&" not in text:
        return text.lower()
    t = unicodedata.normalize("NFKD", html.unescape(text)).casefold()
    return "".join(c for c in t if not unicodedata.combining(c))


def _roman(s: str) -> int | None:
    total = 0
    for a, b in zip(s, [*s[1:], ""]):
        v = _ROMAN[a]
        total += -v if b and _ROMAN[b] > v else v
    return total if 0 < total < 40 else None


def within_one_edit(a: str, b: str) -> bool:
    """Whether at most one letter is put in, left out or changed, or two neighbours are swapped."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    a, b = a[i:], b[i:]
    return a[1:] == b[1:] or a[1:] == b or a == b[1:] or (a[2:] == b[2:] and a[:2] == b[1::-1])


def _misspelt_side(t: str) -> tuple[str, int] | None:
    """The side word that a title's end nearly spells, and where it starts."""
    for ending in _ENDINGS:
        if (m := ending.search(t)) and m.start() > 0 and not _NOT_SIDE.fullmatch(m[1]):
            for w in _SIDE_WORDS:
                # One edit leaves the first or the last letter as it is.
                if abs(len(m[1]) - len(w)) < 2 and (m[1][0] == w[0] or m[1][-1] == w[-1]) and within_one_edit(m[1], w):
                    return w, m.start()
    return None


def title_key(title: str | None) -> tuple[str, str, str]:
    """(main title as bare letters and digits, subtitle likewise, part): 'The X: A Tale (Complete), Part IV' -> ('x', 'atale', '4')."""
    t = " ".join(fold(title).replace("_", " ").replace("&", " and ").split())
    while (cut := _REMARK.sub("", t).rstrip()) != t:
        t = cut
    part = ""
    if (m := _SIDE.search(t)) and m.start() > 0:
        part, t = m[1][:4], t[: m.start()]
    elif side := _misspelt_side(t):
        part, t = side[0][:4], t[: side[1]]
    elif (m := _NUMBER.search(t)) and m.start() > 0:
        number = m[1] or m[2]
        n = int(number) if number.isdigit() else _roman(number)
        if n is not None:
            part, t = str(n), t[: m.start()]
    t = re.sub(r"[,\s]+(?:the|a|an)\s*$", "", t)
    t = re.sub(r"^\s*(?:the|a|an)\s+", "", t)
    main, _, sub = t.partition(":")
    main, sub = ("".join(_NO_ALNUM.sub("", x).split()) for x in (main, sub))
    return (main, sub, part) if main else (sub, "", part)


def author_key(author: str | None) -> tuple[str, str] | None:
    """(last name, first initial); handles of one word are a last name."""
    a = re.sub(r"^by\s+", "", fold(author).strip())
    if a in PLACEHOLDERS:
        return None
    if "," in a:
        last, _, first = a.partition(",")
        a = f"{first} {last}"
    w = re.findall(r"[^\W_]+", a)
    return (w[-1], w[0][0]) if w else None


def grams(s: str) -> set[str]:
    s = f"^{s}$"
    return {s[i : i + 2] for i in range(len(s) - 1)}


_HASHES: dict[str, int] = {}


def _hash(item: str) -> int:
    """The same number in every process; what was hashed is remembered, within bounds."""
    h = _HASHES.get(item)
    if h is None:
        if len(_HASHES) > 200_000:
            _HASHES.clear()
        h = _HASHES[item] = zlib.crc32(item.encode())
    return h


def places(items: set[str], words: int) -> list[int]:
    return sorted({_hash(g) % (64 * words) for g in items})


def packed(at: list[int], words: int) -> list[int]:
    out = [0] * words
    for i in at:
        out[i >> 6] |= 1 << (i & 63)
    return [x - (1 << 64) if x >> 63 else x for x in out]


def _key(*parts: object) -> int:
    text = repr(parts).encode()
    return (zlib.crc32(text) << 31) ^ zlib.crc32(b"folioworks" + text)


def _text_items(text: str | None) -> set[int]:
    """Numbers of the text's sequences of three words; of all its words, where there are only two."""
    text = text or ""
    w = [_hash(x) for x in _NO_ALNUM.sub("", fold(_TAG.sub(" ", text) if "<" in text else text)).split()]
    return {(x * 31 + y) * 31 + z for x, y, z in zip(w, w[1:], w[2:])} or ({w[0] * 31 + w[1]} if len(w) > 1 else set())


def _number(text: object) -> float | None:
    s = re.sub(r"\D", "", str(text)) if text is not None else ""
    return float(s) if s and float(s) > 0 else None


def encode(df: DataFrame) -> DataFrame:
    """Vectors and facts of rows (key, title, author, site, text, year, tags array, size). The size is in any unit."""
    fields = "key long, class_a long, class_b long, title array<long>, sub array<long>, author array<long>, text array<long>, tags array<long>, part long, site string, year int, size double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in fields.split(", ")]
        kinds = {"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "double": pa.float64(), "array<long>": pa.list_(pa.int64())}
        types = [kinds[f.split(" ", 1)[1]] for f in fields.split(", ")]
        for b in batches:
            rows = []
            for key, title, author, site, text, year, tags, size in zip(*(c.to_pylist() for c in b.columns)):
                main, sub, part = title_key(title)
                if not main or key is None:
                    continue
                a = author_key(author)
                items = _text_items(text)
                tagged = {fold(t) for t in tags or [] if t}
                rows.append(
                    (
                        key,
                        _key(main, part, a) if a else None,
                        _key(main, part),
                        packed(places(grams(main), TITLE_WORDS), TITLE_WORDS),
                        packed(places(grams(sub), TITLE_WORDS), TITLE_WORDS) if sub else None,
                        packed(places(grams(a[0]) | {"initial " + a[1]}, AUTHOR_WORDS), AUTHOR_WORDS) if a else None,
                        packed(sorted({x % (64 * TEXT_WORDS) for x in items}), TEXT_WORDS) if items else None,
                        packed(places(tagged, TAG_WORDS), TAG_WORDS) if tagged else None,
                        _key(part),
                        site or None,
                        year,
                        _number(size),
                    )
                )
            cols = list(zip(*rows)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], names=names)

    return df.select("key", "title", "author", "site", "text", F.col("year").cast("int"), "tags", F.col("size").cast("string")).mapInArrow(run, fields)


def _bits(a: str, words: int) -> Column:
    return sum((F.bit_count(F.col(a)[i]) for i in range(1, words)), F.bit_count(F.col(a)[0]))


def _common(a: str, b: str, words: int) -> Column:
    return sum((F.bit_count(F.col(a)[i].bitwiseAND(F.col(b)[i])) for i in range(1, words)), F.bit_count(F.col(a)[0].bitwiseAND(F.col(b)[0])))


def _dice(a: str, b: str, words: int) -> Column:
    return 2.0 * _common(a, b, words) / (_bits(a, words) + _bits(b, words))


def _overlap(a: str, b: str, words: int) -> Column:
    return _common(a, b, words) / F.least(_bits(a, words), _bits(b, words))


def _grows(df: DataFrame) -> DataFrame:
    """A join side that grows with the data: it is never broadcast, whatever its files' size suggests."""
    return df.hint("merge")


def key_subsets(words: int, radius: int, size: int) -> list[tuple[int, ...]]:
    """Sets of ``size`` chunks such that two vectors within the radius agree in all chunks of at least one set.

    At least words - radius chunks are equal. Dealt into fewer than (words - radius) / (size - 1) groups, some group has ``size`` of them.
    """
    equal = words - radius
    groups = (equal - 1) // (size - 1) if size > 1 else words
    if groups < 1:
        raise ValueError("too few chunks for this radius")
    return [s for g in range(groups) for s in combinations(range(g, words, groups), size)]


def close_classes(left: DataFrame, right: DataFrame, words: int, radius: int, size: int, wanted: Column | None = None) -> DataFrame:
    """Pairs of unequal classes (class, scope, vector, and what ``wanted`` needs) whose vectors are within the radius, and some a little
    further apart: left_class, right_class, each pair once. ``wanted`` is a condition on the columns left_flag and right_flag."""
    subsets = F.array(*[F.array(*[F.lit(i) for i in s]) for s in key_subsets(words, radius, size)])
    sides = []
    for n, d in (("left", left), ("right", right)):
        # Keys of few bits: the left side is cut by class, the right side stands under every salt.
        own = F.array(F.pmod("class", F.lit(SALTS))) if n == "left" else F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")

        def keys(s: Column) -> Column:
            held = [F.get("vector", s[k]) for k in range(size)]
            bits = sum((F.bit_count(h) for h in held[1:]), F.bit_count(held[0]))
            salts = F.when(bits < SALTED_BELOW, own).otherwise(F.array(F.lit(0).cast("bigint")))
            return F.transform(salts, lambda salt: F.xxhash64("scope", salt, *[s[k] for k in range(size)], *held))

        fold = F.aggregate("vector", F.lit(0).cast("bigint"), lambda x, w: x.bitwiseXOR(w))
        flag = [F.col("flag").alias(f"{n}_flag")] if wanted is not None else []
        sides.append(d.select(F.col("class").alias(f"{n}_class"), fold.alias(f"{n}_fold"), *flag, F.explode(F.flatten(F.transform(subsets, keys))).alias("index_key")))
    pairs = sides[0].join(_grows(sides[1]), "index_key")
    near = (F.bit_count(F.col("left_fold").bitwiseXOR(F.col("right_fold"))) <= radius) & (F.col("left_class") != F.col("right_class"))
    return pairs.where(near if wanted is None else near & wanted).select("left_class", "right_class").distinct()


def _expand(pairs: DataFrame, left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Rows of close classes, and of equal ones: left_key, right_key. Sides are (class, key, and ``on``).

    Every left row meets a class of the right in blocks of rows, so a class that holds a third of all rows is many tasks' work.
    """
    equal = left.select(F.col("class").alias("left_class"), F.col("class").alias("right_class")).distinct()
    sizes = right.groupBy(F.col("class").alias("right_class")).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > BLOCK_ROWS)
    sizes = sizes.select("right_class", F.ceil(F.col("__n") / BLOCK_ROWS).cast("int").alias("blocks"))
    pairs = pairs.unionByName(equal).join(_grows(sizes), "right_class", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = pairs.join(_grows(left.select(F.col("class").alias("left_class"), F.col("key").alias("left_key"), *on)), "left_class")
    rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    other = right.select(F.col("class").alias("right_class"), F.col("key").alias("right_key"), *on).join(_grows(sizes), "right_class", "left")
    other = other.withColumn("block", F.pmod(F.xxhash64("right_key"), F.coalesce("blocks", F.lit(1))).cast("int")).drop("blocks")
    return rows.join(_grows(other), ["right_class", "block", *on]).select("left_key", "right_key")


def _tokens(rows: DataFrame, left: bool) -> DataFrame:
    """(class, key, case, place) such that a left and a right row share one case and place just where an author is missing on either
    side, and the sites are equal or one is missing. Case 1: left lacks the author. Case 2: right only."""
    lacks, site = F.col("author").isNull(), F.col("site")
    cases = F.when(lacks, F.array(F.lit(1))).otherwise(F.array(F.lit(2))) if left else F.when(lacks, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    named = F.concat(F.lit("="), site)
    if left:
        places = F.when(site.isNull(), F.array(F.lit("left without"))).otherwise(F.array(named, F.lit("right without")))
    else:
        places = F.when(site.isNull(), F.array(F.lit("right without"), F.lit("left without"))).otherwise(F.array(named, F.lit("left without")))
    return rows.select(F.col("class_b").alias("class"), "key", F.explode(cases).alias("case"), places.alias("p")).select("class", "key", "case", F.explode("p").alias("place"))


def candidate_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """left_key and right_key of all rows that A or B bring together, each pair once: A has an author on both sides, B has not."""
    both = [d.where(F.col("author").isNotNull()).select(F.col("class_a").alias("class"), "key", F.col("part").alias("scope"), F.concat("title", "author").alias("vector")) for d in (left, right)]
    classes = [d.groupBy("class").agg(F.any_value("scope").alias("scope"), F.any_value("vector").alias("vector")) for d in both]
    out = _expand(close_classes(*classes, TITLE_WORDS + AUTHOR_WORDS, BOTH_RADIUS, BOTH_KEY_CHUNKS), *both, [])

    titles = [d.groupBy(F.col("class_b").alias("class")).agg(F.any_value("part").alias("scope"), F.any_value("title").alias("vector"), F.bool_or(F.col("author").isNull()).alias("flag")) for d in (left, right)]
    near = close_classes(*titles, TITLE_WORDS, TITLE_RADIUS, TITLE_KEY_CHUNKS, F.col("left_flag") | F.col("right_flag"))
    return out.unionByName(_expand(near, _tokens(left, True), _tokens(right, False), ["case", "place"]))


def scored_pairs(left: DataFrame, right: DataFrame, pairs: DataFrame) -> DataFrame:
    """Field values of each pair within the radius, the weighted score without the texts, and the texts' overlap (null where one is missing)."""
    facts = ["title", "sub", "author", "text", "tags", "site", "year", "size"]
    for side, df in (("left", left), ("right", right)):
        pairs = pairs.join(_grows(df.select(F.col("key").alias(f"{side}_key"), *[F.col(f).alias(f"{side}_{f}") for f in facts])), f"{side}_key")
    apart = lambda f, words: _bits(f"left_{f}", words) + _bits(f"right_{f}", words) - 2 * _common(f"left_{f}", f"right_{f}", words)
    together = apart("title", TITLE_WORDS) + apart("author", AUTHOR_WORDS)
    pairs = pairs.where(F.when(together.isNotNull(), together <= BOTH_RADIUS).otherwise(apart("title", TITLE_WORDS) <= TITLE_RADIUS))
    both = lambda f: F.col(f"left_{f}").isNotNull() & F.col(f"right_{f}").isNotNull()
    title = _dice("left_title", "right_title", TITLE_WORDS)
    subtitle = F.when(both("sub"), _dice("left_sub", "right_sub", TITLE_WORDS))
    ratio = F.abs(F.log(F.col("left_size") / F.col("right_size")))
    values = {
        # A subtitle may be left out, but two different ones tell titles apart.
        "title": F.least(title, F.coalesce(subtitle, title)),
        "author": F.when(both("author"), _dice("left_author", "right_author", AUTHOR_WORDS)),
        "site": F.when(both("site"), (F.col("left_site") == F.col("right_site")).cast("double")),
        "year": F.when(both("year"), (F.col("left_year") == F.col("right_year")).cast("double")),
        "tags": F.when(both("tags"), _overlap("left_tags", "right_tags", TAG_WORDS)),
        "length": F.when(both("size"), F.greatest(F.lit(0.0), 1.0 - ratio / 0.7)),
    }
    scored = pairs.select("left_key", "right_key", *[v.alias(f) for f, v in values.items()], F.when(both("text"), _overlap("left_text", "right_text", TEXT_WORDS)).alias("text"))
    top = sum((F.coalesce(F.col(f) * w, F.lit(0.0)) for f, w in WEIGHTS.items()), F.lit(0.0))
    low = sum((F.when(F.col(f).isNotNull(), w).otherwise(0.0) for f, w in WEIGHTS.items()), F.lit(0.0))
    return scored.withColumn("score", top / low)


def isotonic(scores: np.ndarray, hits: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Non-decreasing shares of hits by score (pool adjacent violators), drawn towards 1/2 by one case in each pool."""
    pools: list[list[float]] = []
    for k in range(len(scores)):
        pools.append([hits[k], totals[k], 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            h, t, n = pools.pop()
            pools[-1][0] += h
            pools[-1][1] += t
            pools[-1][2] += n
    return np.concatenate([np.full(int(n), (h + 0.5) / (t + 1)) for h, t, n in pools]) if pools else np.zeros(0)


def with_confidence(scored: DataFrame, bins: int = 200) -> DataFrame:
    """Add ``confidence``: how likely a pair with this score, and with these texts, is one work.

    The share of pairs with the same text rises with the score, from d among pairs that agree in nothing to e among the best ones: texts of
    different works are the same with probability d, those of one work with probability e. Between them the share tells how
    many pairs are one work; a pair's own texts then move that by Bayes' rule. Both ends are pools of the isotonic fit.
    Only ``bins`` counts reach the driver. Without any pair that has two texts the score itself is the confidence.
    """
    binned = F.floor(F.col("score") * bins).cast("int")
    rows = scored.where(F.col("text").isNotNull()).groupBy(binned.alias("b")).agg(F.count_if(F.col("text") >= TEXT_SAME).alias("h"), F.count(F.lit(1)).alias("n")).orderBy("b").collect()
    if not rows:
        return scored.withColumn("confidence", F.col("score"))
    b = np.array([r[0] for r in rows])
    share = isotonic(b, np.array([r[1] for r in rows], float), np.array([r[2] for r in rows], float))
    table = np.interp(np.arange(bins + 1), b, share)
    d, e = float(table.min()), float(table.max())
    if e - d < 1e-6:
        d, e = 0.0, 1.0
    prior = np.clip((table - d) / (e - d), 1e-4, 1 - 1e-4)
    base = F.get(F.array(*[F.lit(float(x)) for x in prior / (1 - prior)]), binned)
    d, e = max(d, 1e-4), min(e, 1 - 1e-4)
    odds = base * F.when(F.col("text").isNull(), 1.0).when(F.col("text") >= TEXT_SAME, e / d).otherwise((1 - e) / (1 - d))
    return scored.withColumn("confidence", odds / (1 + odds))


def match_entities(left_rows: DataFrame, right_rows: DataFrame) -> DataFrame:
    """All candidate pairs: left_key, right_key, the field values, score and confidence."""
    left = materialize(encode(left_rows), "match-left")
    right = materialize(encode(right_rows), "match-right")
    scored = materialize(scored_pairs(left, right, candidate_pairs(left, right)), "match-scored")
    discard(left, right)
    return with_confidence(scored)
