import random
import re
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pytest

from folioworks.llm import container_packing as packing
from folioworks.llm import entity_matching as matching
from folioworks.llm import eval_leakage as leakage
from folioworks.llm import language_segments as language
from folioworks.llm import queries as Q
from folioworks.llm.term_frequency import canonical_term, canonical_terms, mark_terms, term_counts

# ---- problem 1 ----


def test_terms_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr("folioworks.llm.term_frequency.HEAVY", 64)
    monkeypatch.setattr("folioworks.llm.term_frequency._WORDS", 1)
    rng = random.Random(5)
    words = ["Common", "common ", "CAFÉ", "cafe\u0301", "A &amp; B", "a\u00a0 & b", *[f"w{i}" for i in range(200)]]
    rows = [("f", rng.choice([None, *range(60)]), [rng.choice(words[:6] if rng.random() < 0.6 else words) for _ in range(rng.randrange(5))]) for _ in range(800)]
    rows += [("g", 1, None), ("g", 1, ["x", "x"]), ("h", 2, [])]
    df = spark.createDataFrame(rows, "field string, rec long, terms array<string>")
    occ, rec, total = Counter(), defaultdict(set), defaultdict(set)
    for f, r, ts in rows:
        if r is not None:
            total[f].add(r)
        for t in ts or []:
            k = (f, canonical_term(t))
            occ[k] += 1
            rec[k] |= {r} - {None}
    got = {(r.field_name, r.term): (r.n_occurrences, r.n_records, r.total_records, r.mark) for r in mark_terms(term_counts(canonical_terms(df, "terms"), "field", "rec", "terms", "test")).collect()}
    mark = lambda n, t: "rare" if n < 5 else "common" if n > 0.05 * t else None
    assert got == {k: (occ[k], len(rec[k]), len(total[k[0]]), mark(len(rec[k]), len(total[k[0]]))) for k in occ}


def test_terms_of_nothing(spark):
    df = spark.createDataFrame([], "field string, rec long, terms array<string>")
    assert term_counts(df, "field", "rec", "terms", "test").count() == 0


# ---- problem 5 ----


@pytest.mark.parametrize(
    "text,want",
    [
        ("The Long Way Back, Part IV - edited", ("longwayback", "", "4")),
        ("Long_Way_Back,_The #12 (Complete)", ("longwayback", "", "12")),
        ("A Tale & Co: Notes of X [Updated]", ("taleandco", "notesofx", "")),
        ("X *NEW*", ("x", "", "")),
        ("Reunion - Epilogue", ("reunion", "", "epil")),
        ("1984", ("1984", "", "")),
        (None, ("", "", "")),
    ],
)
def test_title_key(text, want):
    assert matching.title_key(text) == want


def test_misspelt_side_words_are_parts():
    for word in ("Prologue", "Epilogue", "Side Story", "Side Stories", "Interlude", "Sequel"):
        want = matching.title_key(f"A Whistle - {word}")
        assert want == ("whistle", "", word[:4].lower())
        for i in range(len(word)):
            for near in (word[:i] + word[i + 1 :], word[:i] + "k" + word[i:], word[:i] + "k" + word[i + 1 :], word[:i] + word[i + 1 : i + 2] + word[i] + word[i + 2 :]):
                assert matching.title_key(f"A Whistle - {near}") == want, near
    for title in ("The Harbour Prequel", "A Whistle for the Wide Story", "The Inside Story of Oran", "Sequins", "A Sequel2"):
        assert matching.title_key(title)[2] == "", title


def test_index_keys_miss_nothing_within_the_radius():
    rng = random.Random(1)
    for words, radius, size in ((18, 9, 3), (12, 7, 2), (10, 9, 1)):
        subsets = matching.key_subsets(words, radius, size)
        for _ in range(500):
            hit = {rng.randrange(words) for _ in range(radius)}
            assert any(not hit & set(s) for s in subsets)


def test_all_pairs_within_the_radius_are_found(spark, sf):
    """Every pair of rows of the whole tables within the radius, by brute force over their vectors, is a candidate."""
    seen = {}
    spy = lambda left, right: seen.update(sides=[matching.encode(d).cache() for d in (left, right)])
    old, Q.match_entities = Q.match_entities, spy
    try:
        with pytest.raises(AttributeError):
            Q.p5_pairs(spark, sf)
    finally:
        Q.match_entities = old
    rows = [d.collect() for d in seen["sides"]]
    got = {tuple(r) for r in matching.candidate_pairs(*seen["sides"]).collect()}
    bits = lambda rs, f, words: np.array([getattr(r, f) or [0] * words for r in rs], dtype=np.int64).view(np.uint64)
    title, author = [bits(rs, "title", matching.TITLE_WORDS) for rs in rows], [bits(rs, "author", matching.AUTHOR_WORDS) for rs in rows]
    want = set()
    for i, x in enumerate(rows[0]):
        t = np.bitwise_count(title[0][i] ^ title[1]).sum(axis=1)
        both = t + np.bitwise_count(author[0][i] ^ author[1]).sum(axis=1)
        for j in np.flatnonzero(t <= matching.BOTH_RADIUS):
            y = rows[1][j]
            if x.part == y.part and (both[j] <= matching.BOTH_RADIUS if x.author and y.author else t[j] <= matching.TITLE_RADIUS and (x.site == y.site or not x.site or not y.site)):
                want.add((x.key, y.key))
    assert len(want) > 50 and want <= got


def test_a_hot_title_is_expanded_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(matching, "BLOCK_ROWS", 3)
    cols = "key long, title string, author string, site string, text string, year int, tags array<string>, size double"
    left = [(k, "Crossroads", "Mira Toranby" if k % 2 else None, "s1" if k % 3 else None, None, None, None, None) for k in range(20)]
    right = [(100 + k, "crossroads!", "Mira Toranby" if k % 5 else None, "s1" if k % 2 else None, None, None, None, None) for k in range(20)]
    got = [tuple(r) for r in matching.candidate_pairs(*[matching.encode(spark.createDataFrame(x, cols)) for x in (left, right)]).collect()]
    want = {(a[0], b[0]) for a in left for b in right if (a[2] and b[2]) or a[3] == b[3] or not a[3] or not b[3]}
    assert len(got) == len(set(got)) and set(got) == want


def test_matches_on_a_small_fixture(spark):
    cols = "key long, title string, author string, site string, text string, year int, tags array<string>, size double, extra string"
    text = "a tired courier carried the wooden chest along the harbour wall before the storm came back again"
    left = [(1, "The Wicker Gate of Oran - Pt. 02", "Mira Toranby", "s1", text, 2020, ["x"], 3000.0, "e"), (2, "The Bet", "Anonymous", "s1", text, 2020, None, 900.0, "e"), (3, None, "a b", "s1", None, None, None, None, "e"), (4, "", "", "", "", None, [], None, "e")]
    right = [
        (11, "WICKER GAET OF ORAN, THE (2)", "Toranby, M.", "s1", text, 2020, ["x", "y"], 3100.0, "e"),
        (12, "The Wicker Gate of Oran (3)", "Mira Toranby", "s1", None, 2020, ["x"], 3000.0, "e"),
        (13, "The Bet", "Nils Doran", "s2", "quite another text that has nothing at all in common with it", 2011, None, 90000.0, "e"),
        (14, "Bet, The", "Nils Doran", "s1", text, 2020, None, 910.0, "e"),
        (11, "WICKER GAET OF ORAN, THE (2)", "Toranby, M.", "s1", text, 2020, ["x", "y"], 3100.0, "e"),
    ]
    frames = [spark.createDataFrame(x, cols) for x in (left, right)]
    got = {(r.left_key, r.right_key) for r in matching.match_entities(*frames).where("confidence >= 0.5").collect()}
    assert got == {(1, 11), (2, 14)}
    assert matching.match_entities(frames[0].limit(0), frames[1]).count() == 0


def test_pairs_without_author_and_site_are_found_by_title(spark):
    cols = "key long, title string, author string, site string, text string, year int, tags array<string>, size double"
    left = [(1, "The Quarry at Sarorrin, Part IV", "Anonymous", "s1", None, 2020, ["x"], 3000.0), (2, "A Beacon for Belanford", "Mira Toranby", "s1", None, 2020, ["x"], 900.0), (3, "Tidal Almanac", None, None, "b " * 9, 2020, ["x"], 900.0)]
    right = [(11, "The Quarry at Sarorrin 04", "Bram Melurfell", None, "some other text of its own", 2020, ["x"], 3000.0), (12, "a beacon for belanfrod", None, None, None, 2020, ["x"], 900.0), (13, "TIDAL ALMANAC", "Nils Doran", "s2", "one more text", 2020, ["x"], 900.0)]
    frames = [matching.encode(spark.createDataFrame(x, cols)) for x in (left, right)]
    assert {tuple(r) for r in matching.candidate_pairs(*frames).collect()} == {(1, 11), (2, 12), (3, 13)}


def test_isotonic():
    p = matching.isotonic(np.arange(4), np.array([0.0, 5, 3, 10]), np.array([10.0, 10, 10, 10]))
    assert (np.diff(p) >= 0).all() and p[0] < 0.1 < 0.9 < p[3] and p[1] == p[2]


def test_known_pairs_are_found(spark, sf):
    """Exact title, part and author on the same site are the same work; nearly all such pairs must come out."""
    rows = {n: [r for r in spark.read.parquet(f"{sf}/{n}.parquet").collect() if r.title and matching.author_key(r.author)] for n in ("library_books", "story_meta")}
    key = lambda r: (*matching.title_key(r.title)[::2], matching.author_key(r.author), r.site)
    by = defaultdict(list)
    for r in rows["story_meta"]:
        by[key(r)].append(r.meta_id)
    want = {(r.book_key, m) for r in rows["library_books"] if r.site for m in by[key(r)]}
    got = {(r.book_key, r.meta_id) for r in Q.p5_found(spark, sf).collect()}
    assert len(want) > 20 and len(want & got) >= 0.97 * len(want)


# ---- problem 6 ----


def test_plan_places_every_item_once():
    rng = np.random.default_rng(2)
    for window, high in ((30, 40), (1500, 900)):
        lengths, counts = np.unique(np.minimum(rng.integers(0, high, 3000), window), return_counts=True)
        ranges, n = packing.make_plan(lengths, counts, window)
        seen, fill, slots = Counter(), Counter(), set()
        for length, a, z, first, slot in ranges.tolist():
            for r in range(a, z):
                seen[(length, r)] += 1
                fill[first + r - a] += length
                assert (first + r - a, slot) not in slots
                slots.add((first + r - a, slot))
        assert seen == Counter({(int(x), r): 1 for x, c in zip(lengths, counts) for r in range(c)})
        assert max(fill.values()) <= window and set(fill) == set(range(n))
        assert n <= 1.03 * np.ceil((lengths * counts).sum() / window) + 1


def test_packed_documents(spark, sf):
    docs = spark.createDataFrame([(1, "one two three"), (2, None), (3, ""), (4, "word " * 3000), (4, "again"), (5, "x")], "doc_id long, text string")
    specs = spark.createDataFrame([(1, 64, 1, "e"), (2, None, 1, "e"), (3, 0, 0, "e"), (4, 100000, None, "e")], "spec_id long, capacity_tokens long, separator_tokens long, slot string")
    rows = packing.pack_documents(docs, specs, packing.tokenizer_path()).collect()
    assert {r.spec_id for r in rows} == {1, 4} and {r.doc_id for r in rows} == {1, 3, 4, 5}
    big = sorted((r.piece_no, r.first_token, r.n_tokens) for r in rows if r.spec_id == 1 and r.doc_id == 4 and r.n_pieces > 1)
    assert [p for p, _, _ in big] == list(range(1, len(big) + 1)) and all(n == 64 for _, _, n in big[:-1]) and all(f == (p - 1) * 64 for p, f, _ in big)
    for spec, cap, sep in ((1, 64, 1), (4, 100000, 0)):
        held = defaultdict(list)
        for r in rows:
            if r.spec_id == spec:
                held[r.container_id].append(r.n_tokens)
        assert all(sum(v) + sep * (len(v) - 1) <= cap for v in held.values())
    assert packing.pack_documents(docs.limit(0), specs, packing.tokenizer_path()).count() == 0


def test_fill_is_high(spark, sf):
    for r in Q.p6_fill(spark, sf).collect():
        assert r.fullest <= r.capacity_tokens and r.containers <= 1.02 * r.tokens / r.capacity_tokens + 1


# ---- problem 7 ----


def brute(item, doc, passage=28):
    """Whether the document holds `passage` consecutive item words with at most one changed, missing or added, the slow way."""
    n = 0
    for i in range(len(item)):
        for j in range(len(doc)):
            # run, then one edit, then run
            a = 0
            while i + a < len(item) and j + a < len(doc) and item[i + a] == doc[j + a]:
                a += 1
            for di, dj in ((1, 1), (1, 0), (0, 1)):
                if i + a + di > len(item):
                    n = max(n, a)
                    continue
                b = 0
                while i + a + di + b < len(item) and j + a + dj + b < len(doc) and item[i + a + di + b] == doc[j + a + dj + b]:
                    b += 1
                n = max(n, a + di + b)
                if i > 0:
                    n = max(n, a + 1)
    return n >= passage


def test_leaks_equal_brute_force(spark):
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(45))) for i in range(1, 7)]
    docs = [(100, None), (101, ""), (102, "short")]
    for k in range(120):
        words = [rng.choice(vocab) for _ in range(rng.randrange(20, 90))]
        _, text = rng.choice(items)
        w, start, n = text.split(), rng.randrange(18), rng.randrange(20, 34)
        piece = w[start : start + n]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(piece))
            piece[at : at + 1] = rng.choice([[], ["new"], [piece[at], "more"]])
        if piece:
            piece[0] = f"<b>{piece[0].upper()}</b>,"
        at = rng.randrange(len(words))
        docs.append((200 + k, " ".join(words[:at] + piece + words[at:])))
    docs.append((200, docs[3][1]))
    df = spark.createDataFrame([(a, b, "x") for a, b in docs], "doc_id long, text string, item_id string")
    idf = spark.createDataFrame([*items, (99, None), (98, "few words")], "item_id long, text string")
    want = {(i, d) for d, t in docs for i, x in items if t and brute(leakage.words_of(x), leakage.words_of(t))}
    for shard in (60, 100_000):
        got = leakage.leaked_passages(df, idf, shard_words=shard)
        assert {(r.item_id, r.doc_id) for r in got.collect()} == want
    assert 10 < len(want) < 120
    clean = leakage.clean_documents(df, leakage.leaked_passages(df, idf))
    assert {r.doc_id for r in clean.collect()} == {d for d, _ in docs} - {d for _, d in want}
    assert leakage.leaked_passages(df.limit(0), idf).count() == 0 and leakage.leaked_passages(df, idf.limit(0)).count() == 0


def test_words():
    assert leakage.words_of("<p>Café\u00a0&amp; “Ex-\n am</p><p>ple\u200b</p> naïve— — <i>in</i>side") == ["cafe", "exam", "ple", "naive", "inside"]


def test_ranks_order_suffixes_and_measure_matches():
    rng = np.random.default_rng(5)
    w = np.concatenate([rng.integers(0, 2, 60), [-2], np.tile([3, 1, 2], 12), [-3], np.tile([3, 1, 2], 14), [-4]])
    ranks = leakage.suffix_ranks(w, 6)
    for depth, rank in ranks:
        subs = [tuple(w[i : i + depth]) for i in range(len(w))]
        assert all((rank[i] < rank[j]) == (subs[i] < subs[j]) for i in range(len(w)) for j in range(len(w)))
    pairs = [(i, j) for i in range(len(w)) for j in range(len(w)) if i != j]
    got = leakage.common_words(ranks, *(np.array(x) for x in zip(*pairs)))
    for (i, j), n in zip(pairs, got):
        assert n == next(k for k in range(len(w)) if max(i, j) + k >= len(w) or w[i + k] != w[j + k])


# ---- problem 8 ----


def test_segments(spark, sf):
    got = Q.p8_segments(spark, sf).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r.doc_id for r in got} <= set(docs) and all(0 <= r.confidence <= 1 for r in got)
    # Cyrillic against Latin is certain: the segments' languages must agree with the script.
    for r in got:
        if r.n_segments == 1:
            letters = [c for c in docs[r.doc_id].text if c.isalpha()]
            cyr = sum("CYRILLIC" in unicodedata.name(c, "") for c in letters)
            assert (cyr > len(letters) / 2) == (r.seg_lang == "ru")
    for k in {r.doc_id for r in got}:
        own = sorted((r for r in got if r.doc_id == k), key=lambda r: r.seg_no)
        assert [r.seg_no for r in own] == list(range(1, len(own) + 1))
        assert all(a.seg_lang != b.seg_lang for a, b in zip(own, own[1:])) and (len(own) == 1 or all(r.seg_words >= 12 for r in own))


def test_distances_use_whole_words_and_counts():
    lang = list(language.LANGUAGES)
    counts = {lang[0]: Counter(language.word_grams("dedede")), lang[1]: Counter(language.word_grams("quququ")), lang[2]: Counter(language.word_grams("x"))}
    profiles = language.Profiles(counts)
    units = [["de" * 20 + "qu" * 30], ["x"] * 900 + ["de"] * 300, ["qu", "de"]]
    for unit, got in zip(units, profiles.distances(units)):
        own = Counter(profiles.ids[g] for w in unit for g in language.word_grams(w) if g in profiles.ids)
        ranked = sorted(own, key=lambda g: (-own[g], g))
        for k in range(len(lang)):
            away = sum(own[g] * min(abs(int(profiles.ranks[k][g]) - r), profiles.worst) for r, g in enumerate(ranked))
            assert got[k] == pytest.approx(away / (sum(own.values()) * profiles.worst))


def test_held_out_accuracy(spark, sf):
    """Profiles of half the evaluation items name the language of the other half, whole and in mixed texts."""
    items = [(r.item_lang, r.text) for r in spark.read.parquet(f"{sf}/eval_items.parquet").collect()]
    random.Random(4).shuffle(items)
    train, test = items[: len(items) // 2], items[len(items) // 2 :]
    profiles = language.train_profiles(train, [])
    one = list(language.segment_batch(profiles, [t for _, t in test], language.SWITCH_COST, language.MIN_WORDS))
    right = sum(len([s for s in one if s[0] == k]) == 1 and language.LANGUAGES[next(s for s in one if s[0] == k)[2]] == lang for k, (lang, _) in enumerate(test))
    assert right >= 0.97 * len(test)
    mixed = [(a, b) for a, b in zip(test, test[1:]) if a[0] != b[0]]
    two = list(language.segment_batch(profiles, [f"{a[1]}\n\n{b[1]}" for a, b in mixed], language.SWITCH_COST, language.MIN_WORDS))
    right = sum([language.LANGUAGES[s[2]] for s in two if s[0] == k] == [a[0], b[0]] for k, (a, b) in enumerate(mixed))
    assert right >= 0.95 * len(mixed)


def test_segments_of_odd_texts(spark):
    profiles = language.train_profiles([("en", "the house and the garden of the old man"), ("de", "das haus und der garten des alten mannes")], [])
    df = spark.createDataFrame([(1, None, "en", "x"), (2, "", "en", "x"), (3, "12 !!", None, "x"), (4, "the garden " * 20_000, "English", "x"), (4, "the garden of the man", "de", "x")], "doc_id long, text string, lang string, seg_no string")
    rows = language.language_segments(df, profiles).collect()
    assert sorted((r.doc_id, r.seg_lang, r.label_lang) for r in rows) == [(4, "en", "de"), (4, "en", "en")]
    assert language.language_segments(df.limit(0), profiles).count() == 0


def test_labels(spark):
    forms = ["en", "EN", "en-GB", "en_US", "English", "ger", "Deutsch", "pt-BR", "uk", "und", "", " ", None]
    df = spark.createDataFrame([(f,) for f in forms], "lang string").select(language.label_language(language.F.col("lang")).alias("l"))
    assert [r.l for r in df.collect()] == ["en"] * 5 + ["de", "de", "pt", None, None, None, None, None]


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query_columns(spark, sf, name):
    df = Q.queries()[name](spark, sf)
    assert df.count() > 0
    found = {"p1_found": ["field_name", "term", "mark"], "p5_found": ["book_key", "meta_id"], "p7_found": ["item_id", "doc_id"], "p8_found": ["doc_id", "seg_no", "seg_lang"]}
    assert df.columns == found.get(name, df.columns) and re.match(r"p\d+_", name)
