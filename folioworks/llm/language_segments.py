"""The language of every document and of every part that changes language, by rank-order profiles.

A language's profile is the list of its most frequent character n-grams. A text's distance to it is the out-of-place
distance: for each n-gram of the text the difference of its rank in the text and in the profile, and a fixed worst
value where the profile lacks it. Sentences are the units; a Viterbi pass joins them into segments, paying for each
change of language, and a stretch of fewer than ``min_words`` words never starts a segment of its own.

The profiles are trained on a bounded sample of the labelled documents (and on reliable texts, where there are any): first on all of
it, then only on the sentences that the first profiles confirm. Its size is a parameter; everything else runs over whole texts.

Units of a batch are ranked together in numpy: words are looked up once per spelling, and two sorts give all ranks.

Defined results: a null or empty text, or one without any letter, gives no row; unknown scripts fall to the closest
language with a low confidence; ties go to the language that is first in the list; an exact copy gives the same rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioworks.session import spread

LANGUAGES = ("en", "de", "fr", "es", "it", "pt", "nl", "ru")
#: n-grams of a profile, and the documents of the training sample (expected number; they are drawn by a hash of the id).
PROFILE_GRAMS = 400
SAMPLE_DOCUMENTS = 3000
MIN_WORDS = 12
#: Cost of a change of language in Viterbi, in words that fit one language entirely and another not at all.
SWITCH_COST = 1.2

# How labels name a language, without region.
LABELS = {
    "en": "en eng english",
    "de": "de deu ger german deutsch",
    "fr": "fr fra fre french français francais",
    "es": "es spa spanish español espanol castellano",
    "it": "it ita italian italiano",
    "pt": "pt por portuguese português portugues",
    "nl": "nl nld dut dutch nederlands",
    "ru": "ru rus russian русский",
}

_TAG = re.compile(r"<(?:/?[a-zA-Z][^<>]*|!--.*?--)>|&#?\w+;", re.S)
_LINE_HYPHEN = re.compile(r"(?<=\w)-[^\S\n]*\r?\n\s*(?=\w)")
_UNIT_END = re.compile(r"[.!?…:;\n][\"'”’»“)\]]*\s+|\n|\s(?=[„“«»‘])")
#: Letters form words; END, set at the ends of sentences, stands for itself.
END = "\x00"
_TOKEN = re.compile(r"[^\W\d_]+|\x00")
_MARKS = re.compile(r"[\u0300-\u036f]+")


def label_language(label: Column) -> Column:
    """The language a label names, whatever its form, else null."""
    base = F.lower(F.regexp_replace(F.trim(label), r"[-_].*$", ""))
    out = None
    for lang, forms in LABELS.items():
        hit = base.isin(*forms.split())
        out = F.when(hit, lang) if out is None else out.when(hit, lang)
    return out


def fold(text: str) -> str:
    """Lower case without accents, markup and hyphens at line ends."""
    if "<" in text or "&" in text:
        text = _TAG.sub(" ", text)
    if "\n" in text:
        text = _LINE_HYPHEN.sub("", text)
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text)).replace("\u200b", "").replace("\u00ad", "")
    return text.lower()


def tokens_of(text: str) -> list[str]:
    """The folded text's words, with END behind each sentence."""
    return _TOKEN.findall(_UNIT_END.sub(" \x00 ", fold(text).replace(END, " ")))


def units_of(text: str) -> list[list[str]]:
    """The sentences as lists of words."""
    out: list[list[str]] = [[]]
    for t in tokens_of(text):
        if t == END:
            out.append([])
        else:
            out[-1].append(t)
    return [u for u in out if u]


def word_grams(word: str) -> list[str]:
    """Bigrams and trigrams of the word with its edges."""
    w = f" {word} "
    return [w[i : i + 2] for i in range(len(w) - 1)] + [w[i : i + 3] for i in range(len(w) - 2)]


class Profiles:
    """Rank tables of all languages over the union of their n-grams."""

    def __init__(self, counts: dict[str, Counter], tables: tuple[dict[str, int], np.ndarray] | None = None):
        self.worst = PROFILE_GRAMS
        self._forget()
        if tables:
            self.ids, self.ranks = tables
            return
        ranked = {lang: [g for g, _ in sorted(counts.get(lang, Counter()).items(), key=lambda x: (-x[1], x[0]))[:PROFILE_GRAMS]] for lang in LANGUAGES}
        self.ids = {g: i for i, g in enumerate(dict.fromkeys(g for r in ranked.values() for g in r))}
        self.ranks = np.full((len(LANGUAGES), len(self.ids) + 1), -10 * PROFILE_GRAMS, dtype=np.int32)
        for k, lang in enumerate(LANGUAGES):
            for r, g in enumerate(ranked[lang]):
                self.ranks[k, self.ids[g]] = r

    def _forget(self) -> None:
        self._words: dict[str, int] = {END: 0}
        self._new: list[list[int]] = [[]]
        self._sizes = self._table = np.zeros(0, dtype=np.int64)

    def _word(self, word: str) -> int:
        at = self._words[word] = len(self._sizes) + len(self._new)
        self._new.append([self.ids[g] for g in word_grams(word) if g in self.ids])
        return at

    def unit_distances(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For tokens with END behind each unit: how many units end before each token, each unit's words, and its mean out-of-place
        distance to each language, from 0 to 1; 1 where a unit has no known n-gram."""
        if len(self._words) > 200_000:
            self._forget()
        known = list(map(self._words.get, tokens))
        if None in known:
            for i, (t, k) in enumerate(zip(tokens, known)):
                if k is None:
                    k = self._words.get(t)
                    known[i] = self._word(t) if k is None else k
        words = np.array(known, dtype=np.int64)
        if self._new:
            more = np.fromiter(map(len, self._new), dtype=np.int64, count=len(self._new))
            self._table = np.concatenate([self._table, np.fromiter((g for w in self._new for g in w), dtype=np.int64, count=int(more.sum()))])
            self._sizes = np.concatenate([self._sizes, more])
            self._new = []
        sizes, table = self._sizes, self._table
        starts = np.cumsum(sizes) - sizes
        ends = words == 0
        ended = np.concatenate([[0], np.cumsum(ends)])
        unit = ended[:-1]
        n_units = int(ends.sum())
        n_words = np.bincount(unit[~ends], minlength=n_units)
        out = np.ones((n_units, len(LANGUAGES)))
        n = sizes[words]
        total = int(n.sum())
        if not total:
            return ended, n_words, out
        at = np.repeat(starts[words] - np.cumsum(n) + n, n) + np.arange(total)
        # unit and n-gram in one number; sorted, equal neighbours are counted.
        pairs = np.sort((np.repeat(unit, n) << 16) | table[at])
        edge = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
        count = np.diff(np.append(edge, total))
        # Bits that the largest count takes, and numbers that hold the largest sum of distances.
        top, bits = int(count.max()), int(count.max()).bit_length()
        kind = np.int64 if total * self.worst >= 1 << 31 else np.int32
        pairs = pairs[edge]
        # Rank in the unit: by falling count, ties in the order of the table.
        keys = np.sort(((pairs >> 16) << (16 + bits)) | ((top - count) << 16) | (pairs & 0xFFFF))
        of, count, gram = keys >> (16 + bits), (top - ((keys >> 16) & ((1 << bits) - 1))).astype(kind), keys & 0xFFFF
        first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        rank = (np.arange(len(of)) - np.repeat(first, np.diff(np.append(first, len(of))))).astype(kind)
        weight = np.add.reduceat(count, first) * float(self.worst)
        for k in range(len(LANGUAGES)):
            away = np.abs(self.ranks[k][gram] - rank)
            np.minimum(away, self.worst, out=away)
            away *= count
            out[of[first], k] = np.add.reduceat(away, first) / weight
        return ended, n_words, out

    def distances(self, units: list[list[str]]) -> np.ndarray:
        """Distances of units given as lists of words."""
        return self.unit_distances([t for u in units for t in (*u, END)])[2]


def _viterbi(cost: np.ndarray, switch: float) -> np.ndarray:
    n, k = cost.shape
    best, back = cost[0].copy(), np.zeros((n, k), dtype=np.int64)
    for i in range(1, n):
        least = int(best.argmin())
        stay = best <= best[least] + switch
        back[i] = np.where(stay, np.arange(k), least)
        best = np.where(stay, best, best[least] + switch) + cost[i]
    path = np.empty(n, dtype=np.int64)
    path[-1] = int(best.argmin())
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i][path[i]]
    return path


def _segments(cost: np.ndarray, words: np.ndarray, switch: float, min_words: int) -> list[tuple[int, int, int]]:
    """(language, first unit, end unit) of one document; short stretches are given to the neighbour that fits them better."""
    total = cost.sum(axis=0)
    lead = int(total.argmin())
    if (cost.argmin(axis=1) == lead).all():
        return [(lead, 0, len(cost))]
    path = _viterbi(cost, switch)
    while True:
        cut = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(path)]
        runs = [(int(path[a]), a, b, int(words[a:b].sum())) for a, b in zip(cut, cut[1:])]
        short = [r for r in runs if r[3] < min_words]
        if len(runs) == 1 or not short:
            return [r[:3] for r in runs]
        lang, a, b, _ = min(short, key=lambda r: (r[3], r[1]))
        sides = {int(path[x]) for x in (a - 1, b) if 0 <= x < len(path)}
        path[a:b] = min(sorted(sides), key=lambda s: cost[a:b, s].sum())


def segment_batch(profiles: Profiles, texts: list[str | None], switch: float, min_words: int) -> Iterator[tuple[int, int, int, float, int]]:
    """(text, segment number, language, confidence, words) of each segment."""
    tokens: list[str] = []
    bounds = [0]
    for t in texts:
        if t:
            tokens += tokens_of(t)
            tokens.append(END)
        bounds.append(len(tokens))
    ended, words, dist = profiles.unit_distances(tokens)
    # Units of each text: the ENDs among its tokens; those without a word are skipped.
    unit_bounds = ended[np.array(bounds)]
    keep = words > 0
    unit_bounds = np.concatenate([[0], np.cumsum(keep)])[unit_bounds]
    words, dist = words[keep], dist[keep]
    # What matters is how much worse a language is than the best; a unit weighs as its words do.
    cost = (dist - dist.min(axis=1, keepdims=True)) * words[:, None]
    for k in range(len(texts)):
        own = slice(int(unit_bounds[k]), int(unit_bounds[k + 1]))
        if own.start == own.stop:
            continue
        for no, (lang, a, b) in enumerate(_segments(cost[own], words[own], switch, min_words), 1):
            n = words[own][a:b]
            mean = (dist[own][a:b] * n[:, None]).sum(axis=0) / n.sum()
            others = np.delete(mean, lang).min()
            gap = max(0.0, (others - mean[lang]) / max(others, 1e-9))
            yield k, no, lang, float(1 - 0.5 * np.exp(-gap * np.sqrt(n.sum()) * 4)), int(n.sum())


def train_profiles(reliable: list[tuple[str, str]], sample: list[tuple[str, str]]) -> Profiles:
    """Profiles of (language, text) pairs: first of the reliable ones, then with the sample's texts that agree with them."""
    words: dict[str, Counter] = {lang: Counter() for lang in LANGUAGES}

    def add(lang: str, units: list[list[str]]) -> None:
        if lang in words:
            for u in units:
                words[lang].update(u)

    def profiles() -> Profiles:
        """Each distinct word is cut into n-grams once and counts as often as it occurs."""
        counts: dict[str, Counter] = {lang: Counter() for lang in LANGUAGES}
        for lang, own in words.items():
            for w, n in own.items():
                for g in word_grams(w):
                    counts[lang][g] += n
        return Profiles(counts)

    for lang, text in reliable:
        add(lang, units_of(text))
    first = profiles()
    if not reliable:
        for lang, text in sample:
            add(lang, units_of(text))
        first = profiles()
        words = {lang: Counter() for lang in LANGUAGES}
    for start in range(0, len(sample), 500):
        labelled = [(lang, u) for lang, text in sample[start : start + 500] for u in units_of(text)]
        near = first.distances([u for _, u in labelled]).argmin(axis=1)
        # Only the sentences that agree: a labelled text may hold parts in other languages.
        for (lang, u), k in zip(labelled, near):
            if LANGUAGES[k] == lang:
                add(lang, [u])
    return profiles()


def labelled_sample(documents: DataFrame, expected: int = SAMPLE_DOCUMENTS) -> list[tuple[str, str]]:
    """About ``expected`` labelled texts, drawn by a hash of the id, so that their number does not grow with the table."""
    n = documents.count()
    if not n:
        return []
    share = min(1.0, expected / n)
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20))
    rows = documents.where(drawn & F.col("text").isNotNull()).select(label_language(F.col("lang")).alias("l"), "text").where("l IS NOT NULL")
    return [(r[0], r[1]) for r in rows.collect()]


def language_segments(documents: DataFrame, profiles: Profiles, switch: float = SWITCH_COST, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per segment: doc_id, label_lang (what documents.lang names, or null), seg_no, seg_lang, confidence, seg_words,
    n_segments, and main_lang, the language most words are in."""
    shared = documents.sparkSession.sparkContext.broadcast((profiles.ids, profiles.ranks))
    names = ["doc_id", "label_lang", "seg_no", "seg_lang", "confidence", "seg_words", "n_segments", "main_lang"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Profiles({}, shared.value)
        for b in batches:
            for part in _bounded(b, 1_500_000):
                ids, labels, texts = (part.column(i).to_pylist() for i in range(3))
                by_doc: dict[int, list] = {}
                for k, no, lang, conf, n in segment_batch(known, texts, switch, min_words):
                    by_doc.setdefault(k, []).append((no, lang, conf, n))
                rows = []
                for k, segs in by_doc.items():
                    weight = Counter()
                    for _, lang, _, n in segs:
                        weight[lang] += n
                    main = LANGUAGES[min(weight, key=lambda x: (-weight[x], x))]
                    rows += [(ids[k], labels[k], no, LANGUAGES[lang], conf, n, len(segs), main) for no, lang, conf, n in segs]
                cols = list(zip(*rows)) if rows else [[]] * 8
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds)], names=names)

    slim = documents.select("doc_id", label_language(F.col("lang")).alias("label_lang"), "text")
    return spread(slim).mapInArrow(run, "doc_id long, label_lang string, seg_no long, seg_lang string, confidence double, seg_words long, n_segments long, main_lang string")


def _bounded(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of about ``most`` bytes of text, so that memory does not follow the batch size."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(2)), 0))
    cut = np.concatenate([[0], np.flatnonzero(np.diff(np.cumsum(lengths) // most)) + 1, [batch.num_rows]])
    for a, b in zip(cut, cut[1:]):
        if b > a:
            yield batch.slice(a, b - a)
