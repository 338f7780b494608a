"""Evaluation passages inside a training corpus, by suffix arrays over corpus shards.

Each task cuts its documents into shards of bounded size, builds the word-level suffix array of a shard by prefix doubling
in numpy, and binary-searches every suffix of every evaluation item in it. That gives all verbatim matches of at least
``seed`` words. The ranks of all depths are kept: two suffixes are equal as far as their ranks are, and beyond the greatest depth the
ranks of the places further on continue the comparison, so every match is measured to its full length by the array, many at
once. Each maximal match is then carried on across one changed, missing or added word. With one error in ``passage`` words one
side of it has at least ``passage // 2`` words verbatim, so a seed of that length misses nothing. The corpus is never shuffled.

Words are what white space separates, after character references, markup, case, accents, punctuation, Unicode form and
hyphens at line ends are taken away; what is punctuation only is no word.

Defined results: null and empty texts match nothing; items shorter than ``passage`` words match nothing; a text in several
rows is reported for each of them; an item that stands in several rows of the item table is reported under each id.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from folioworks.session import spread

PASSAGE_WORDS = 28
#: Words of a shard: the suffix array and its scratch space take about 80 bytes a word.
SHARD_WORDS = 600_000
#: Words of evaluation items searched at once; a larger item set is searched in several blocks.
BLOCK_WORDS = 2_000_000

# Elements that do not end a word.
_INLINE = re.compile(r"</?(?:b|i|u|s|em|strong|span|a|small|sub|sup|font|mark|code)(?:\s[^<>]*)?/?>", re.I)
_TAG = re.compile(r"<(?:/?[a-zA-Z][^<>]*|!--.*?--)>", re.S)
_LINE_HYPHEN = re.compile(r"[-‐\u00ad][^\S\n]*\r?\n\s*")
_NO_WORD = re.compile(r"[^\w\s]|_")


def words_of(text: str) -> list[str]:
    """The words of a text in the form in which they are compared."""
    if "<" in text:
        text = _TAG.sub(" ", _INLINE.sub("", text))
    if "&" in text:
        text = html.unescape(text)
    if "\n" in text:
        text = _LINE_HYPHEN.sub("", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
    return _NO_WORD.sub("", text.casefold()).split()


def _ranks(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].astype(np.int64)


def suffix_ranks(words: np.ndarray, depth: int) -> list[tuple[int, np.ndarray]]:
    """(d, ranks) for d = 1, 2, 4, ... and at last ``depth``: ranks order, and tell apart, the suffixes by their first d words (prefix doubling)."""
    n, have = len(words), 1
    out = [(1, _ranks(words))]
    while have < depth:
        step = min(have, depth - have)
        rank = out[-1][1]
        nxt = np.concatenate([rank[step:], np.full(step, -1, dtype=np.int64)]) + 1
        have += step
        out.append((have, _ranks(rank * (n + 2) + nxt)))
    return out


def common_words(ranks: list[tuple[int, np.ndarray]], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words the suffixes at ``i`` and ``j`` have in common from their beginnings. Texts end in words of their own, so no run passes an end."""
    last = len(ranks[0][1]) - 1
    total = np.zeros(len(i), dtype=np.int64)
    depth, deepest = ranks[-1]
    on = np.arange(len(i))
    while len(on):
        on = on[deepest[np.minimum(i[on] + total[on], last)] == deepest[np.minimum(j[on] + total[on], last)]]
        total[on] += depth
    for d, rank in reversed(ranks[:-1]):
        total += d * (rank[np.minimum(i + total, last)] == rank[np.minimum(j + total, last)])
    return total


def _behind(words: np.ndarray, i: np.ndarray, j: np.ndarray, first_i: np.ndarray, first_j: np.ndarray, most: int) -> np.ndarray:
    """Equal words from ``i`` and ``j`` backwards, ``most`` at most; only those still equal are looked at again."""
    n = np.zeros(len(i), dtype=np.int64)
    on = np.arange(len(i))
    for t in range(most):
        a, b = i[on] - t, j[on] - t
        on = on[(a >= first_i[on]) & (b >= first_j[on]) & (words[a] == words[b])]
        if not len(on):
            break
        n[on] += 1
    return n


def shard_matches(items: list[tuple[int, np.ndarray]], docs: list[tuple[int, np.ndarray]], passage: int) -> np.ndarray:
    """Rows (item id, doc id, passage words, verbatim words, item offset, document offset) of the items in one shard: of each pair the longest
    passage, of equal ones the one with the longest verbatim match, then the first."""
    none = np.zeros((0, 6), dtype=np.int64)
    seed = passage // 2
    if not docs or not items:
        return none
    parts, sizes = [], np.array([len(w) + 1 for _, w in [*items, *docs]])
    for k, (_, w) in enumerate([*items, *docs]):
        parts += [w, np.array([-(k + 2)], dtype=np.int64)]  # ends no two texts share
    words = np.concatenate(parts)
    ends = np.cumsum(sizes) - 1
    starts = ends - sizes + 1
    # Hashes are made non-negative and text ends are negative, so no match crosses a text's end.
    ranks = suffix_ranks(words, seed)
    keys, first_doc = ranks[-1][1], starts[len(items)]
    order = np.argsort(keys[first_doc:], kind="stable")  # the shard's suffix array
    ordered = keys[first_doc:][order]
    queries = np.concatenate([np.arange(s, s + max(0, len(w) - seed + 1)) for s, (_, w) in zip(starts, items)])
    low, high = np.searchsorted(ordered, keys[queries], "left"), np.searchsorted(ordered, keys[queries], "right")
    hits = high - low
    q = np.repeat(queries, hits)
    p = first_doc + order[np.repeat(low, hits) + (np.arange(hits.sum()) - np.repeat(np.cumsum(hits) - hits, hits))]
    # Only left-maximal matches: the words before differ, or one of the texts begins.
    left = (q == 0) | (words[np.maximum(q - 1, 0)] != words[p - 1]) | (words[p - 1] < 0)
    q, p = q[left], p[left]
    if not len(q):
        return none
    of_q, of_p = np.searchsorted(starts, q, "right") - 1, np.searchsorted(starts, p, "right") - 1
    length = common_words(ranks, q, p)
    # Ahead: one word changed, missing or added, then what follows. A document's end has nothing behind it.
    i, j = q + length, p + length
    inside, more = i < ends[of_q], j < ends[of_p]
    ahead = np.where(inside, 1 + np.where(more, common_words(ranks, i + 1, j + 1), 0), 0)
    ahead = np.maximum(ahead, np.where(inside, 1 + common_words(ranks, i + 1, j), 0))
    ahead = np.maximum(ahead, np.where(more, common_words(ranks, i, j + 1), 0))
    # Behind: the same, the other way.
    i, j, longest = q - 1, p - 1, int(sizes[: len(items)].max())
    inside = i >= starts[of_q]
    back = lambda a, b: _behind(words, a, b, starts[of_q], starts[of_p], longest)
    before = np.where(inside, 1 + np.maximum(back(i - 1, j - 1), back(i - 1, j)), 0)
    before = np.maximum(before, back(i, j - 1))
    held = length + np.maximum(ahead, before)
    keep = np.flatnonzero(held >= passage)
    best = keep[np.lexsort((p[keep], q[keep], -length[keep], -held[keep], of_p[keep], of_q[keep]))]
    new = np.concatenate([[True], (of_q[best][1:] != of_q[best][:-1]) | (of_p[best][1:] != of_p[best][:-1])]) if len(best) else np.zeros(0, dtype=bool)
    best = best[new]
    item_ids, doc_ids = np.array([i for i, _ in items], dtype=np.int64), np.array([d for d, _ in docs], dtype=np.int64)
    return np.stack([item_ids[of_q[best]], doc_ids[of_p[best] - len(items)], held[best], length[best], (q - starts[of_q])[best], (p - starts[of_p])[best]], axis=1)


def _hashed(words: list[str]) -> np.ndarray:
    """Word numbers; they hold within one process, where both sides are made."""
    return np.fromiter(map(hash, words), dtype=np.int64, count=len(words)) & 0x7FFFFFFFFFFFFFFF


def leaked_passages(documents: DataFrame, items: DataFrame, passage: int = PASSAGE_WORDS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row per item and document that holds a passage of it.

    Columns: item_id, doc_id, passage_words, verbatim_words (the longest verbatim match), item_word, doc_word (where it begins).
    The items are the stated query set: they go to all tasks and are searched in blocks of at most BLOCK_WORDS words.
    """
    spark = documents.sparkSession
    texts = [(r[0], words_of(r[1])) for r in items.select("item_id", "text").where("text IS NOT NULL AND item_id IS NOT NULL").distinct().collect()]
    shared = spark.sparkContext.broadcast([(i, w) for i, w in sorted(texts) if len(w) >= passage])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, size = [[]], 0
        for i, w in shared.value:
            if size + len(w) > BLOCK_WORDS and blocks[-1]:
                blocks.append([])
                size = 0
            blocks[-1].append((i, _hashed(w)))
            size += len(w)

        def flush(docs: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
            rows = np.concatenate([shard_matches(b, docs, passage) for b in blocks])
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in rows.T], names=["item_id", "doc_id", "passage_words", "verbatim_words", "item_word", "doc_word"])

        docs, have = [], 0
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                w = _hashed(words_of(text.as_py()))
                if len(w) < passage - 1:
                    continue
                docs.append((doc_id, w))
                have += len(w)
                if have >= shard_words:
                    yield flush(docs)
                    docs, have = [], 0
        if docs:
            yield flush(docs)

    slim = documents.select("doc_id", "text").where("text IS NOT NULL AND doc_id IS NOT NULL")
    return spread(slim).mapInArrow(search, "item_id long, doc_id long, passage_words long, verbatim_words long, item_word long, doc_word long")


def clean_documents(documents: DataFrame, matches: DataFrame) -> DataFrame:
    """The documents that hold no passage of any item."""
    return documents.join(matches.select("doc_id").distinct(), "doc_id", "left_anti")
