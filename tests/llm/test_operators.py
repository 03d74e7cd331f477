"""The corpus operators against brute force, and on awkward rows."""

import collections
import hashlib
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import corpora
from tidemark.llm import decontamination, exact_search, language_id, license_scan, mixing, near_duplicates, pii, sharding, substring_dedup, toxicity


def counted(df):
    return collections.Counter(tuple(r) for r in df.collect())


def test_long_labelled_texts_teach(spark):
    """A language that stands only on texts longer than a stretch is learned; of many labels each has its share."""
    rng = np.random.RandomState(5)
    speak = lambda letters, n: "".join(rng.choice(list(letters), n))
    rows = [(i, speak("aeioun ", 300), "aa") for i in range(60)] + [(i, speak("bcdfgk ", 20_000), "bb") for i in range(100, 130)]
    out = language_id.identify_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert all(r.lang_pred == r.lang for r in out)
    many = [(i, speak("abcdefgh ", 3000), f"l{i % 1000:04d}") for i in range(3000)]
    sample = language_id.labelled_sample(spark.createDataFrame(many, "doc_id long, text string, lang string"), F.col("text"), F.col("lang"))
    assert len({language for language, _ in sample}) == language_id.MOST_LANGUAGES
    assert sum(len(text) for _, text in sample) <= language_id.SAMPLE_TOTAL


# ---- 7: many items with one opening


def test_items_that_open_alike(spark):
    """Texts that hold the opening of many items overlap each of them; that is found in time that pairs of arrays take."""
    rng = np.random.RandomState(4)
    say = lambda n: " ".join(f"w{x}" for x in rng.randint(0, 100_000, n))
    opening = say(14)
    items = [(f"i{k}", f"{opening} {say(40)}") for k in range(150)]
    docs = [(k, f"{say(60)} {opening} {say(60)}") for k in range(150)] + [(1000, say(200))]
    began = time.monotonic()
    out = decontamination.contaminations(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")).collect()
    assert len({(r.doc_id, r.item_id) for r in out}) == len(out) == 150 * 150
    assert all(r.doc_id < 1000 and r.start_word == 60 and r.n_equal >= 14 for r in out)
    assert time.monotonic() - began < 60


# ---- 4: repeated passages


def brute_repeats(rows, window):
    first = {}
    for i, t in rows:
        w = (t or "").encode().split()
        for p in range(len(w) - window + 1):
            if i is not None:
                key = tuple(w[p : p + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = set()
        for p in range(len(w) - window + 1):
            if i is not None and first[tuple(w[p : p + window])] < i:
                gone.update(range(p, p + window))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return collections.Counter(out)


@pytest.mark.parametrize("window", [50, 12])
def test_repeats_equal_brute_force(spark, window):
    docs = corpora.documents(spark)
    got = counted(substring_dedup.remove_repeats(docs, window=window, with_text=False))
    assert got == brute_repeats([(r[0], r[1]) for r in corpora.rows()], window)


def test_kept_text_is_what_is_hashed(spark):
    for r in substring_dedup.remove_repeats(corpora.documents(spark)).collect():
        assert hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256


def test_repeats_of_no_rows(spark):
    assert substring_dedup.remove_repeats(corpora.empty(spark)).count() == 0


# ---- 3: language


def brute_phrases(text, trained):
    n = i = 0
    while i < len(text):
        k = 1
        while i + k < len(text) + 1 and text[i : i + k] in trained:
            k += 1
        i += max(1, k - 1)
        n += 1
    return n


def test_phrases_are_greedy_longest_matches():
    sample = [("aa", "the cat sat on the mat and then the cat ran"), ("bb", "der hund und die katze und das haus und der wald")]
    model = language_id.learn(sample)
    texts = ["the dog and the cat", "und dann der hund!!", "Zebra", "", "x"]
    codes, ends = language_id._read(texts, model.symbols)
    counts, letters = language_id.phrases(codes, ends, model)
    parts = [codes[a:b].tolist() for a, b in zip([0, *(ends[:-1] + 1)], ends, strict=True)]
    for number, (_, trained) in enumerate(sorted(sample)):
        own, _ = language_id._read([trained], model.symbols)
        known = "".join(chr(200 + c) for c in own.tolist())
        for t, part in enumerate(parts):
            want = brute_phrases("".join(chr(200 + c) for c in part), known)
            # letters that the language has never seen are phrases of their own
            assert counts[number][t] == want
    assert letters.tolist() == [sum(c.isalpha() for c in t) for t in texts]
    found, score = language_id.classify(["\U0001f600 12", "\U00020000", "", "\u00e9"], model)  # unseen letters are letters
    assert found.tolist()[0] == -1 and found.tolist()[1] >= 0 and found.tolist()[2] == -1 and score[0] == 0


def test_automata_are_made_by_tasks(spark, monkeypatch):
    sample = [(k, " ".join(f"{k}{i * j % 7}{'aeiou'[i % 5]}x" for i in range(40))) for j, k in enumerate(["xa", "yb", "zc"])] + [("none", "12 34")]
    here, there = language_id.learn(sample), language_id.learn_in_tasks(spark, sample)
    assert here.languages == there.languages == ["xa", "yb", "zc"]
    for name in ("symbols", "base", "owner", "target", "roots", "bits"):
        assert (getattr(here, name) == getattr(there, name)).all()

    def never(text):
        raise AssertionError("made by the driver")

    monkeypatch.setattr(language_id, "suffix_automaton", never)
    rows = [(i, text, k) for i, (k, text) in enumerate(sample * 4)]
    out = language_id.identify_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert all(r.lang_pred == (r.lang if r.lang != "none" else "und") for r in out)
    assert language_id.learn_in_tasks(spark, []) is None


@pytest.mark.parametrize("piece", [3, 16])
def test_phrases_do_not_end_with_pieces(monkeypatch, piece):
    monkeypatch.setattr(language_id, "PIECE", piece)
    rng = np.random.RandomState(piece)
    sample = [("aa", "the cat sat on the mat and then the cat ran " * 3), ("bb", "der hund und die katze " + "ab " * 30), ("cc", "\u6f22\u5b57\u304b\u306a the")]
    model = language_id.learn(sample)
    texts = ["".join(rng.choice(list("theca snduq"), rng.randint(0, 200))) for _ in range(60)]
    texts += ["ab " * 100, "the cat sat on the mat and then the cat ran " * 5, "\u6f22\u5b57 the cat", "x" * 90, "", "q"]
    codes, ends = language_id._read(texts, model.symbols)
    counts, _ = language_id.phrases(codes, ends, model)
    as_text = lambda codes: "".join(chr(200 + c) for c in codes.tolist())
    for number, (_, trained) in enumerate(sorted(sample)):
        known = as_text(language_id._read([trained], model.symbols)[0])
        want = [brute_phrases(as_text(codes[a:b]), known) for a, b in zip([0, *(ends[:-1] + 1)], ends, strict=True)]
        assert counts[number].tolist() == want


def test_predictions_equal_plain_parses(spark):
    """The query's prediction and score of each row, from its own sample, by parses that try all lengths."""
    rng = np.random.RandomState(8)
    docs = corpora.documents(spark, n=40)
    sample = language_id.labelled_sample(docs.where("doc_id is not null").where(language_id.fold(F.col("doc_id")) != 2), F.col("text"), F.col("lang"))
    model = language_id.learn(sample)
    texts_of = {}
    for language, text in sample:
        texts_of.setdefault(language, []).append(text)
    as_text = lambda codes: "".join(chr(200 + c) for c in codes.tolist())
    coded = lambda text: as_text(language_id._read([text], model.symbols)[0][:-1])  # noqa: E731  (without the mark of its end)
    # a language's text is its sample in the model's order, so its length is what the model says
    length = dict(zip(model.languages, 2**model.bits, strict=True))
    rows = language_id.identify_languages(docs.drop("score", "held_out")).collect()
    assert len(rows) == len(corpora.rows(n=40))
    learned = {k: as_text(language_id._read([t for name, t in sorted(sample) if name == k], model.symbols)[0]) for k in texts_of}
    assert all(abs(len(learned[k]) - length[k]) < 1e-6 for k in learned)
    for r in rng.permutation(len(rows))[:25]:
        r = rows[r]
        letters = sum(c.isalpha() for c in r.text or "")
        if not letters:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        cost = sorted((brute_phrases(coded(r.text), learned[k]) * np.log2(length[k]) / letters, k) for k in learned)
        if cost[1][0] - cost[0][0] > 1e-9:
            assert r.lang_pred == cost[0][1]
        assert abs(r.score - min(1, max(0, 1 - cost[0][0] / cost[1][0]))) < 1e-6


def test_scripts_and_many_languages_are_told_apart(spark):
    rng = np.random.RandomState(3)
    letters = {f"l{i:02d}": [chr(0x4E00 + 40 * i + k) for k in range(30)] for i in range(40)}
    rows = []
    for i in range(40 * 12):
        language = f"l{i % 40:02d}"
        rows.append((i, "".join(rng.choice(letters[language], 50 if i else 30_000)), language))
    out = language_id.identify_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    held = out.where("held_out").collect()
    assert len(held) > 50 and all(r.lang_pred == r.lang for r in held)
    assert {r.lang_pred for r in out.where("doc_id = 0").collect()} == {"l00"}


def test_copies_do_not_fill_the_sample(spark):
    rows = [(i, "one and the same text", "en") for i in range(400)] + [(1000 + i, f"another text number {'abcdefghijklmnopqrstuvwxyz'[i]}", "en") for i in range(20)] + [(2000, "z" * 9000, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = language_id.labelled_sample(docs, F.col("text"), F.col("lang"))
    # the long text teaches, too, by a stretch of it
    assert len(sample) == 22 and len(set(sample)) == 22
    assert max(len(text) for _, text in sample) == language_id.STRETCH


def test_language_of_awkward_rows(spark):
    out = language_id.identify_languages(corpora.documents(spark)).collect()
    assert len(out) == len(corpora.rows())
    for r in out:
        if r.text is None or not any(c.isalpha() for c in r.text):
            assert r.lang_pred == "und"
        else:
            assert r.lang_pred in ("en", "fr")
        assert 0 <= r["_score"] <= 1 and r.score in (None, 1.0)
    assert language_id.identify_languages(corpora.empty(spark)).count() == 0
    none = corpora.documents(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language_id.identify_languages(none).collect()} == {"und"}


def test_language_held_out_accuracy(spark):
    english = "the cat sat on the mat and then it ran to the house with the dog"
    german = "der hund lief durch den wald und dann nach haus zu der katze"
    rows = [(i, " ".join(np.random.RandomState(i).permutation((english if i % 2 else german).split())), "en" if i % 2 else "de") for i in range(80)]
    out = language_id.identify_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).where("held_out").collect()
    assert out and np.mean([r.lang == r.lang_pred for r in out]) > 0.95


# ---- 5: sharding


def test_lookup_table_is_even_and_stable():
    names = sharding.shard_names(10)
    table = sharding.lookup_table(names, 251)
    sizes = collections.Counter(table)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and set(table) == set(range(10))
    fewer = sharding.lookup_table(names[:9], 251)
    assert sum(a != b for a, b in zip(table, fewer, strict=True) if a != 9) < 251 * 0.35
    with pytest.raises(ValueError):
        sharding.lookup_table([])


def test_lookup_table_equals_turns_by_hand():
    """Whole permutations, and each shard's first slot that is free, turn by turn."""
    size, names = 61, sharding.shard_names(7)
    number = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:15], 16)
    orders = [[(number(f"offset {s}") % size + i * (number(f"step {s}") % (size - 1) + 1)) % size for i in range(size)] for s in names]
    assert all(sorted(o) == list(range(size)) for o in orders)
    owner = {}
    while len(owner) < size:
        for shard, order in enumerate(orders):
            free = [x for x in order if x not in owner]
            if free:
                owner[free[0]] = shard
    assert sharding.lookup_table(names, size) == [owner[i] for i in range(size)]


def test_sharding_of_awkward_rows(spark):
    out = sharding.with_shards(corpora.documents(spark), shards=4, size=251).collect()
    assert len(out) == len(corpora.rows())
    by_id = collections.defaultdict(set)
    table = sharding.lookup_table(sharding.shard_names(4), 251)
    for r in out:
        key = str(r.doc_id) if r.doc_id is not None else r.text
        assert r.slot == int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % 251 and r["_shard"] == table[r.slot]
        by_id[r.doc_id].add(r["_shard"])
    assert all(len(v) == 1 for v in by_id.values())
    assert sharding.with_shards(corpora.empty(spark)).count() == 0


# ---- 6: exact search


def test_search_equals_brute_force(spark):
    rng = np.random.RandomState(1)
    rows = [(i, (rng.randn(8) * (0.05 if i % 3 else 1)).tolist()) for i in range(300)]
    rows += [(300, None), (301, [None] * 8), (302, [float("nan")] * 8), (303, [float("inf")] + [0.0] * 7), (304, [1.0, 2.0]), (320, [-0.5]), (307, []), (None, [1.0] * 8), (305, rows[10][1]), (306, rows[10][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in exact_search.top_k(df, F.col("vec_id") % 20 == 0, k=7).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    clean = {i: [int(np.floor(64 * float(np.float32(x)))) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    for q in (i for i in clean if i % 20 == 0):
        best = sorted(((-sum(a * b for a, b in zip(clean[q], v, strict=False)), i) for i, v in clean.items() if i != q))[:7]
        assert sorted(got.pop(q)) == [(n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert not got


def test_search_skips_candidates_beyond_the_bound(spark):
    rng = np.random.RandomState(5)
    centres = rng.randn(20, 6) * 3
    rows = [(i, (centres[i % 20] + 0.05 * rng.randn(6)).tolist()) for i in range(6000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    scored, asked = exact_search.searched(df, F.col("vec_id") % 100 == 0).agg(F.sum("scored"), F.count_distinct("query_id")).first()
    assert asked == 60 and scored < 0.5 * 60 * 6000
    got = {(r.query_id, r["rank"]): r.score for r in exact_search.top_k(df, F.col("vec_id") % 100 == 0, k=5).collect()}
    x = np.floor(64 * np.array([v for _, v in rows]))
    for q in range(0, 6000, 100):
        scores = np.sort(np.delete(x @ x[q], q))[::-1][:5]
        assert [got[q, n + 1] for n in range(5)] == scores.tolist()


def test_search_of_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in exact_search.top_k(df, F.col("vec_id") % 20 == 0).orderBy("rank").collect()] == [(0, 1, 1, 8192), (0, 2, 2, 8192)]
    assert exact_search.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


# ---- 7: decontamination


def test_contaminations_tolerate_substitutions(spark):
    rng = np.random.RandomState(4)
    vocabulary = [f"word{i}" for i in range(5000)]
    items = [(i, " ".join(rng.choice(vocabulary, n))) for i, n in enumerate([30, 40, 15, 9, 6, 3])]
    rows = []
    for d in range(40):
        body = rng.choice(vocabulary, 200).tolist()
        if d < 30:
            item = items[d % 6][1].split()
            if d >= 12 and len(item) > 12:
                for at in range(4, len(item), 9):
                    item[at] = "other"
            body[50:50] = [w.upper() for w in item]
        rows.append((d, ", ".join(body)))
    rows += [(100, None), (101, ""), (None, items[0][1]), (0, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([*items, (9, None), (10, "")], "item_id long, text string")
    found = decontamination.contaminations(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(d, d % 6) for d in range(30) if d % 6 != 5}
    assert all(r.start_word == 50 for r in found)
    kept = decontamination.without_contaminated(docs, bench)
    assert {r.doc_id for r in kept.collect()} == {None, 100, 101, *range(30, 40), *(d for d in range(30) if d % 6 == 5)}
    assert decontamination.contaminations(docs, bench.limit(0)).count() == 0
    assert decontamination.contaminations(docs.limit(0), bench).count() == 0


def test_best_overlap_is_the_best_stretch():
    rng = np.random.RandomState(0)
    for _ in range(60):
        text, item = rng.randint(0, 2, 30), rng.randint(0, 2, 12)
        diagonal = rng.randint(-11, 30)
        start, length, equal = decontamination.best_overlap(text, item, diagonal)
        score = lambda a, b: sum(1 if text[i] == item[i - diagonal] else -decontamination.PENALTY for i in range(a, b))  # noqa: B023, E731
        lo, hi = max(0, diagonal), min(30, diagonal + 12)
        best = max([0, *(score(a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1))])
        assert score(start, start + length) == best


@pytest.mark.parametrize("size", [8, 15, 20, 30, 60])
def test_overlaps_are_those_that_the_rule_accepts(size):
    rng = np.random.RandomState(size)
    accepted = 0
    for n in range(150):
        item = rng.randint(0, 1 << 40, size)
        text = rng.randint(0, 1 << 40, size + 20)
        text[10 : 10 + size] = np.where(rng.rand(size) < (0.1, 0.15, 0.2, 0.3)[n % 4], text[10 : 10 + size], item)
        text[2:8] = item[:6]  # a second diagonal, too short but for small items
        allowed = {}
        for d in (2, 10):
            equal = text[d : d + size] == item
            allowed |= {(d + i, j - i, int(equal[i:j].sum())): d for i in range(size) for j in range(i + 1, size + 1) if decontamination.is_overlap(j - i, int(equal[i:j].sum()), size)}
        got = decontamination.overlap(text, item, [2, 10])
        assert (got is not None) == bool(allowed) and (got is None or got in allowed)
        accepted += got is not None
        widest = decontamination.widest_overlap(text, item, 10)
        assert not any(d == 10 and x[2] > widest[2] for x, d in allowed.items())
    assert accepted > 50


def test_a_copied_item_with_two_changed_words_is_found(spark):
    words = [f"word{i}" for i in range(60)]
    item, body = words[:15], words[20:60]
    changed = ["other" if i in (5, 6) else w for i, w in enumerate(item)]
    docs = spark.createDataFrame([(1, " ".join(body[:20] + changed + body[20:]))], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    assert [tuple(r) for r in decontamination.contaminations(docs, bench).collect()] == [(1, 7, 20, 15, 13, 15)]


def brute_contaminations(docs, items):
    """All pairs, all diagonals: the overlap of most equal words, then the shortest, then the first."""
    out = {}
    read = lambda t: np.array([hash(w) for w in re.findall(r"[0-9a-z]+", (t or "").lower())], dtype=np.int64)
    for d, text in docs:
        for i, item in items:
            a, b = read(text), read(item)
            if not len(a) or not len(b) or len(b) < decontamination.MIN_ITEM and len(a) != len(b):
                continue
            best = decontamination.overlap(a, b, np.arange(-len(b) + 1, len(a)))
            if best:
                out[d, i] = best
    return out


def test_contaminations_equal_all_pairs(spark):
    rng = np.random.RandomState(8)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(n, " ".join(rng.choice(vocabulary, n))) for n in (1, 3, 5, 7, 8, 9, 12, 16, 20, 23, 24, 30, 60)] + [(99, "ha hum " * 40)]
    docs = [(d, " ".join(rng.choice(vocabulary, rng.randint(1, 90)))) for d in range(60)]
    for d in range(60, 260):
        words = items[d % len(items)][1].split()
        words = ["changed" if rng.rand() < (d % 4) * 0.07 else w for w in words]
        lead = rng.choice(vocabulary, rng.randint(0, 30)).tolist()
        docs.append((d, " ".join(lead + words + rng.choice(vocabulary, rng.randint(0, 30)).tolist())))
    docs += [(300, items[0][1]), (301, items[1][1].upper()), (302, "ha hum " * 500)]
    want = brute_contaminations(docs, items)
    clash = "doc_id long, text string, item_id int, begin int, words int, seeds int, start_word int"
    frame = spark.createDataFrame([(d, t, 1, 2, 3, 4, 5) for d, t in docs], clash)
    got = {(r.doc_id, r.item_id): (r.start_word, r.n_words, r.n_equal) for r in decontamination.contaminations(frame, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert set(got) <= set(want) and len(got) >= 0.99 * len(want) and len(want) > 120
    assert all(got[k] == want[k] for k in got)


def test_a_text_of_one_repeated_word(spark):
    docs = spark.createDataFrame([(1, "yes " * 100_000), (2, "yes no " * 4000), (3, "no " * 100)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "yes " * 100_000), (8, "yes " * 500), (9, "yes no " * 4000)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.start_word, r.n_equal) for r in decontamination.contaminations(docs, bench).collect()}
    assert got == {(1, 7): (0, 100_000), (1, 8): (0, 500), (2, 9): (0, 8000)}


# ---- 8: licenses


def test_license_facts(spark):
    rows = [
        (0, "Foo MIT License bar mit-license"),
        (1, "LICENSED under the Apache License, Version 2.0."),
        (2, "the gnu general public license and all rights reserved"),
        (3, "permission is hereby granted, free of charge, to any big person obtaining a copy of this software and associated documentation files (the software), to deal in the software without restriction, including without limitation the rights to use copy modify merge publish"),
        (4, "all rights reserved " * 30),
        (5, None),
        (6, ""),
        (None, "mit license"),
        (7, "nothing at all released under the other license"),
        (0, "another text"),
    ]
    out = collections.Counter(tuple(r)[:7] for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert out[(0, 6, 2, 1, 4, "mit", "mit")] == 1
    assert out[(1, 8, 1, 3, 3, "apache", "apache")] == 1
    assert out[(2, 9, 1, 2, 2, "gpl", "gpl,reserved")] == 1
    assert [k for k in out if k[0] == 3][0][6] == "mit" and [k for k in out if k[0] == 3][0][5] == ""
    assert [k for k in out if k[0] == 4][0][6] == "reserved"
    assert out[(5, 0, 0, None, None, "", "")] == 1 and out[(6, 0, 0, None, None, "", "")] == 1
    assert out[(None, 2, 1, 0, 0, "mit", "mit")] == 1
    assert out[(0, 2, 0, None, None, "", "")] == 1
    assert out[(7, 8, 0, None, None, "", "")] == 1
    assert sum(out.values()) == len(rows)


def test_base_places_equal_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    rng = np.random.RandomState(6)
    parts = ["MIT License", "apache license", "General Public License", "mit", "license", "x-y", "\u00e9t\u00e9", "the", "\n"]
    rows = [(i, " ".join(rng.choice(parts, rng.randint(0, 40)))) for i in range(200)] + [(200, None), (201, ""), (202, "mit license " * 300)]
    got = {tuple(r)[:6] for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string").withColumn("labels", F.lit(1))).collect()}
    con = duckdb.connect()
    con.execute("create table d (doc_id bigint, text varchar)")
    con.executemany("insert into d values (?, ?)", rows)
    # words of lower-cased text, and the places of each phrase in them
    sql = r"""
    with w as (select doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from d),
    p as (select unnest([['mit', 'license'], ['apache', 'license'], ['general', 'public', 'license']]) as phrase, unnest(['mit', 'apache', 'gpl']) as label),
    hit as (select doc_id, label, place from (select doc_id, w, unnest(range(0, len(w))) as place from w) t, p where w[place + 1:place + len(phrase)] = phrase)
    select doc_id, len(any_value(w)), count(place), min(place), max(place), coalesce(string_agg(distinct label, ',' order by label), '') from w left join hit using (doc_id) group by doc_id
    """
    assert got == set(con.execute(sql).fetchall())
    assert license_scan.scan_licenses(corpora.empty(spark)).count() == 0


def test_paragraphs_have_their_own_label_whole_or_changed(spark):
    """Each template alone, with words inserted at two places, with every twelfth word lost, and twice in a row."""
    rng = np.random.RandomState(6)
    rows, want = [], {}
    for label, text in license_scan.TEMPLATES:
        words = text.split()
        kinds = [words]
        if len(words) >= 40:
            a, b = len(words) // 3, 2 * len(words) // 3
            other = [f"x{n}" for n in rng.randint(0, 1000, 12)]
            kinds += [words[:a] + other[:6] + words[a:b] + other[6:] + words[b:], [w for i, w in enumerate(words) if i % 12 != 11], words + words]
        for kind in kinds:
            base = {own for phrase, own in license_scan.BASE if phrase in " ".join(kind)}
            want[len(rows)] = ",".join(sorted(base | {label}))
            rows.append((len(rows), "some text before. " + " ".join(kind) + " And after it."))
    got = {r.doc_id: r for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    wrong = {rows[i][1]: (r.labels, want[i]) for i, r in got.items() if r.labels != want[i]}
    assert not wrong
    grant = license_scan.TEMPLATES[1][1]
    n = len(grant.split())
    spans = license_scan.license_spans(spark.createDataFrame([(1, " ".join([grant] * 3))], "doc_id long, text string")).collect()
    assert sorted((s.first_word, s.last_word, s.coverage) for s in spans) == [(n * i, n * i + n - 1, 1.0) for i in range(3)]


def test_labels_equal_a_plain_alignment(spark):
    """Texts of shuffled pieces of templates against the same rules on lists."""
    rng = np.random.RandomState(7)
    rows = []
    for i in range(80):
        parts = []
        for _ in range(rng.randint(1, 5)):
            words = license_scan.TEMPLATES[rng.randint(len(license_scan.TEMPLATES))][1].split()
            a = rng.randint(0, 1 + len(words) // 3)
            parts += words[a : a + rng.randint(3, 1 + max(4, len(words)))] + [f"y{n}" for n in rng.randint(0, 99, rng.choice([0, 2, 7, 60]))]
        rows.append((i, " ".join(parts)))
    got = {r.doc_id: r.labels for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        found = plain_spans(text.split())
        kept = [s for s in found if not any((o[3], o[4]) > (s[3], s[4]) and 2 * (min(o[2], s[2]) - max(o[1], s[1]) + 1) > min(o[2] - o[1], s[2] - s[1]) + 1 for o in found)]
        base = {label for phrase, label in license_scan.BASE if f" {phrase} " in f" {text} "}
        assert got[i] == ",".join(sorted({s[0] for s in kept} | base)), text


def plain_spans(words):
    k, out = license_scan.K, []
    grams = collections.defaultdict(list)
    for p in range(len(words) - k + 1):
        grams[tuple(words[p : p + k])].append(p)
    for label, text in license_scan.TEMPLATES:
        own = text.split()
        hits = [(p, t) for t in range(len(own) - k + 1) for p in grams[tuple(own[t : t + k])]]
        votes = collections.Counter(p - t for p, t in hits)
        near = lambda p, t: sum(votes[p - t + d] for d in range(-license_scan.BAND, license_scan.BAND + 1))
        best = {}
        for p, t in hits:
            if near(p, t) > 1 or len(own) < license_scan.SHORT_WORDS:
                best[p] = min(best.get(p, (0, 0)), (-near(p, t), t))
        chains = []
        for p, (_, t) in sorted(best.items()):
            if chains and t > chains[-1][-1][1] and p - chains[-1][-1][0] <= license_scan.GAP:
                chains[-1].append((p, t))
            else:
                chains.append([(p, t)])
        for chain in chains:
            covered = len({t + j for _, t in chain for j in range(k)})
            first, last = chain[0][0], chain[-1][0] + k - 1
            share = license_scan.COVERED_SHORT if len(own) < license_scan.SHORT_WORDS else license_scan.COVERED
            if covered >= share * len(own) and covered >= license_scan.DENSE * (last - first + 1):
                out.append((label, first, last, covered, covered / len(own)))
    return out


def test_templates_from_a_folder(spark, tmp_path):
    (tmp_path / "own-1.0.txt").write_text("You may use this thing for as long as you keep it clean and give it back in the evening.")
    docs = spark.createDataFrame([(1, "Notice: you may use this thing for as long as you keep it very clean and give it back in the evening!"), (2, "nothing of the kind")], "doc_id long, text string")
    got = {r.doc_id: r.labels for r in license_scan.scan_licenses(docs, templates=license_scan.templates_in(spark, str(tmp_path))).collect()}
    assert got == {1: "own-1.0", 2: ""}


# ---- 9: near duplicates


def weights_of(rows):
    docs = {i: t.lower().split() for i, t in rows}
    grams = {i: collections.Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) for i, w in docs.items() if w}
    return grams


def test_classes_are_components_of_similar_texts(spark):
    rng = np.random.RandomState(2)
    vocabulary = [f"w{i}" for i in range(2000)]
    rows = []
    for family in range(12):
        base = rng.choice(vocabulary, 120).tolist()
        for copy in range(family):
            words = list(base)
            for _ in range(copy % 4):
                words[rng.randint(120)] = "edit"
            rows.append((len(rows), " ".join(words)))
    rows += [(len(rows) + i, " ".join(rng.choice(vocabulary, 120))) for i in range(30)]
    got = {r.doc_id: r.class_id for r in near_duplicates.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    grams = weights_of(rows)
    parent = {i: i for i in grams}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    close = 0
    for a in grams:
        for b in grams:
            if a < b:
                union = set(grams[a]) | set(grams[b])
                j = len(set(grams[a]) & set(grams[b])) / len(union)
                if j >= 0.84:  # clear of the threshold in either weighting
                    x, y = sorted((root(a), root(b)))
                    parent[y] = x
                elif j >= 0.76:
                    close += 1
    for a in grams:
        for b in grams:
            if root(a) == root(b):
                assert got[a] == got[b]
    lone = [i for i in grams if i >= len(rows) - 30]
    assert all(got[i] == i for i in lone)


def test_twins_inside_a_family_that_shares_boilerplate_meet(spark):
    rng = np.random.RandomState(12)
    vocabulary = [f"w{i}" for i in range(4000)]
    boilerplate = rng.choice(vocabulary, 294).tolist()
    rows = []
    for pair in range(150):
        own = rng.choice(vocabulary, 18).tolist()
        rows += [(2 * pair + k, " ".join(boilerplate + own + rng.choice(vocabulary, 18).tolist())) for k in (0, 1)]
    grams = [set(zip(*(t.split()[i:] for i in range(5)))) for _, t in rows]
    likeness = lambda a, b: len(grams[a] & grams[b]) / len(grams[a] | grams[b])
    assert min(likeness(2 * p, 2 * p + 1) for p in range(150)) > 0.87 and max(likeness(0, i) for i in range(2, 300)) < 0.81
    got = {r.doc_id: r.class_id for r in near_duplicates.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [p for p in range(150) if got[2 * p] != got[2 * p + 1]] == []
    assert len(set(got.values())) == 150


def test_pairs_among_pages_of_common_blocks_meet(spark):
    """Classes of pairs that the module's own weights put at 0.8 or more, where all pages share most of their blocks."""
    import pyarrow as pa

    rng = np.random.RandomState(21)
    vocabulary = [f"w{i}" for i in range(6000)]
    blocks = [rng.choice(vocabulary, 34).tolist() for _ in range(40)]
    rows = []
    for pair in range(100):
        body = [w for b in rng.choice(30, 25, replace=False) for w in blocks[b]] + rng.choice(vocabulary, 150).tolist()
        for _ in range(2):
            words = list(body)
            for at in rng.choice(len(words), 3, replace=False):
                words[at] = f"edit{rng.randint(10**6)}"
            rows.append((len(rows), " ".join(words)))
    got = {r.doc_id: r.class_id for r in near_duplicates.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([t for _, t in rows])], names=["_id", "text"])
    counts = np.zeros(near_duplicates.CELLS, dtype=np.int64)
    for words in near_duplicates.kit.blocks(batch.column("text"), near_duplicates.kit.BLANK_SPLIT, fold=True):
        counts += np.bincount(near_duplicates._cell(near_duplicates.shingles(words)[1]), minlength=near_duplicates.CELLS)
    packed = [x for out in near_duplicates._weighted(batch, near_duplicates.idf_table(counts, len(rows))) for x in out.column("packed").to_pylist()]
    links = [(a, b) for b in range(len(rows)) for a in range(b) if near_duplicates.weighted_jaccard(packed[a], packed[b]) >= 0.8]
    assert len(links) >= 100
    assert [x for x in links if got[x[0]] != got[x[1]]] == []


def test_weights_mean_the_same_at_every_size():
    """Common shingles stand out of cells that rare ones fill evenly."""
    rng = np.random.RandomState(0)
    for docs in (300, 10_000, 10**9):
        rare = rng.poisson(docs * 300 / near_duplicates.CELLS, near_duplicates.CELLS) if docs < 10**8 else np.full(near_duplicates.CELLS, docs * 300 // near_duplicates.CELLS)
        counts = rare.astype(np.int64)
        counts[:3] += [docs, docs // 3, docs // 20]
        idf = near_duplicates.idf_table(counts, docs)
        whole = np.log1p(min(docs, near_duplicates.RARE))
        for cell, share in enumerate((1, 3, 20)):
            assert abs(idf[cell] - 1 - near_duplicates.IDF_SHARE * np.log1p(share) / whole) < 0.03
        assert abs(np.median(idf) - 1 - near_duplicates.IDF_SHARE) < 0.03


def test_near_duplicates_of_awkward_rows(spark):
    out = near_duplicates.near_duplicate_classes(corpora.documents(spark)).collect()
    rows = corpora.rows()
    assert len(out) == len(rows)
    classes = collections.defaultdict(set)
    for r in out:
        classes[r.doc_id].add(r.class_id)
    assert classes[None] == {None} and classes[60] == {60} and classes[61] == {61} and classes[62] == {62}
    copies = collections.defaultdict(set)
    for i, t, *_ in rows:
        if i is not None and t is not None and i != 3:
            copies[t] |= classes[i]
    assert all(len(v) == 1 for v in copies.values())
    assert near_duplicates.near_duplicate_classes(corpora.empty(spark)).count() == 0


def test_samples_collide_as_often_as_texts_are_similar():
    rng = np.random.RandomState(7)
    n = 400
    shared, own = (np.unique(rng.randint(0, 1 << 40, m)).astype(np.uint64) for m in (n, 2 * n))
    parts = [np.sort(np.concatenate([shared, own[:100]])), np.sort(np.concatenate([shared, own[100:200]]))]
    level = np.full(n + 100, near_duplicates.LEVEL_ONE + 20)
    rows, bands = near_duplicates.ROWS, near_duplicates.BANDS
    try:
        near_duplicates.ROWS, near_duplicates.BANDS = 1, 1000
        keys = [near_duplicates.band_keys(np.zeros(n + 100, dtype=np.int64), p, level, 1)[0] for p in parts]
    finally:
        near_duplicates.ROWS, near_duplicates.BANDS = rows, bands
    assert abs(np.mean(keys[0] == keys[1]) - n / (n + 200)) < 0.05


def test_bound_is_no_less_than_the_similarity():
    import pyarrow as pa

    rng = np.random.RandomState(9)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(30):
        base = rng.choice(vocabulary, rng.randint(1, 300)).tolist()
        texts.append(" ".join(base))
        texts.append(" ".join(w if rng.rand() > 0.03 else "edit" for w in base))
    batch = pa.RecordBatch.from_arrays([pa.array(range(60)), pa.array(texts)], names=["_id", "text"])
    (out,) = near_duplicates._weighted(batch, near_duplicates.idf_table(np.ones(near_duplicates.CELLS, dtype=np.int64), 60))
    packed, sums = out.column("packed").to_pylist(), out.column("sums").to_pylist()
    close = 0
    column = pa.array(sums, pa.binary())
    for i in range(60):
        together = near_duplicates.greatest_similarities(pa.array([sums[i]] * 60, pa.binary()), column)
        assert np.allclose(together, [near_duplicates.greatest_similarity(sums[i], x) for x in sums])
    assert np.allclose(near_duplicates.greatest_similarities(column[5:9], column[7:11]), [near_duplicates.greatest_similarity(sums[5 + i], sums[7 + i]) for i in range(4)])
    for i in range(60):
        for j in range(60):
            exact, bound = near_duplicates.weighted_jaccard(packed[i], packed[j]), near_duplicates.greatest_similarity(sums[i], sums[j])
            assert bound >= exact - 1e-9
            close += exact > 0.5
    assert close > 60


def test_connected_components(spark):
    rng = np.random.RandomState(3)
    chain = [(i, i + 1) for i in range(0, 40)]
    random = [(int(a) + 100, int(b) + 100) for a, b in rng.randint(0, 80, (60, 2))]
    links = chain + random + [(7, 7), (3, 2)]
    got = {r.node: r.root for r in near_duplicates.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    parent = {x: x for e in links for x in e}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    assert got == {i: root(i) for i in parent if root(i) != i}


# ---- 2: foreign numbers, named dates


@pytest.mark.parametrize(
    ("value", "kind"),
    [("+44 20 7946 0958", "phone_abroad"), ("+49 (0)30 123456-78", "phone_abroad"), ("+33123456789", "phone_abroad"), ("14 March 2020", "named_date"), ("March 4, 1999", "named_date"), ("04 DEC 2031", "named_date"), ("4111.1111.1111.1111", "card")],
)
def test_more_layouts(value, kind):
    key = b"a key of tests"
    text = f"(see {value}), said they"
    new, found = pii.pseudonymise(text, key)
    assert [f[0] for f in found] == [kind] and new != text and pii.invert(new, key) == text
    shape = lambda t: re.sub(r"[0-9]", "0", re.sub(r"[A-Za-z]{3,}", "x", t))
    assert shape(new) == shape(text)
    assert [f[0] for f in pii.pseudonymise(new, key)[1]] == [kind]


def test_values_are_linked_across_layouts():
    key = b"a key of tests"
    only = lambda t: re.sub(r"[^0-9]", "", pii.pseudonymise(t, key)[0])
    assert only("+44 20 7946 0958") == only("+442079460958")
    new = pii.pseudonymise("14.03.2020 14 March 2020 Mar 14 2020", key)[0]
    day, month, year = new.split()[0].split(".")
    named = pii.MONTHS[int(month) - 1]
    assert new == f"{day}.{month}.{year} {day} {named} {year} {named[:3]} {day} {year}"
    for text in ("+20 000 people came", "31 February 2020", "Maybe 3 2020", "5551234567", "+1234", "14 March 20201", "may 5 or 6"):
        assert pii.pseudonymise(text, key) == (text, [])


# ---- 10: mixing


def test_words_taken_equal_slots_read_one_by_one(spark):
    docs = corpora.documents(spark, n=50)
    mixture = mixing.plan_mixture(docs)
    sources = {r["_source"]: r for r in mixture.sources.collect()}
    # each source's words in order of their places, as (document, number of its copy)
    order = {}
    placed = mixture.docs.where("size > 0").collect()
    for r in placed:
        order.setdefault(r["_source"], []).append(r)
    taken = collections.Counter()
    for name, rows in order.items():
        words = []
        for r in sorted(rows, key=lambda r: r["first"]):
            assert r["first"] == len(words)
            words += [(name, r["first"])] * r["size"]
        assert len(words) == sources[name].source_size
        order[name] = words
    used = collections.Counter()
    for s in mixture.slots.collect():
        words = order[s["_source"]][64 * s.block : 64 * (s.block + 1)]
        assert words
        used[(s["_source"], s["pass"], s.block)] += 1
        for key in words[: s["take"]] if s["take"] is not None else words:
            taken[key] += 1
    assert max(used.values()) == 1
    for r in placed:
        assert taken[(r["_source"], r["first"])] <= 2 * r["size"]
    for name, row in sources.items():
        assert sum(n for (s, _), n in taken.items() if s == name) == round(row.target)
    got = collections.Counter((r.doc_id, r["size"], r.taken) for r in mixing.mixture_counts(docs).collect())
    want = collections.Counter((r["_id"], r["size"], taken[(r["_source"], r["first"])]) for r in placed)
    want.update((r["_id"], 0, 0) for r in mixture.docs.where("size = 0").collect())
    assert got == want


@pytest.mark.parametrize("group", [4096, 2])
def test_shards_draw_their_own_counts(spark, monkeypatch, group):
    """Multinomial counts in shards of one size, which sum up to just the slots of each source."""
    monkeypatch.setattr(mixing, "GROUP", group)
    sizes = {"=a": 30_000, "=b": 10_000, "=c": 20_003, "=d": 1, "=e": 3, "": 700}
    n, shards = sum(sizes.values()), 64
    rows = mixing.drawn_counts(spark.createDataFrame(list(sizes.items()), "_source string, n long"), shards, 7, []).collect()
    assert len({(r["_source"], r.shard) for r in rows}) == len(rows) and all(r.here > 0 for r in rows)
    by_source, by_shard = collections.Counter(), collections.Counter()
    for r in rows:
        by_source[r["_source"]] += r.here
        by_shard[r.shard] += r.here
    assert by_source == sizes
    assert set(by_shard) == set(range(shards)) and {n // shards, n // shards + 1} >= set(by_shard.values())
    for name in ("=a", "=b", "=c"):
        got = [r.here for r in rows if r["_source"] == name]
        part = sizes[name] / n
        assert 0.5 < np.var(got) / (n / shards * part * (1 - part)) < 1.7
    again = mixing.drawn_counts(spark.createDataFrame(list(sizes.items())[::-1], "_source string, n long").repartition(3), shards, 7, []).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, rows))
    assert mixing.drawn_counts(spark.createDataFrame([], "_source string, n long"), shards, 7, []).count() == 0


def test_a_shard_draws_from_a_multinomial():
    """Two sources of 3 slots, a shard of 2: both from the first in a quarter of the draws (a deal of the slots would give a fifth)."""
    both = sum(mixing.draw(2, [3, 3], key)[0] == 2 for key in range(8000))
    assert abs(both / 8000 - 0.25) < 0.02
    lost = mixing.give_up([5, 0, 9], 6, 1)
    assert sum(lost) == 6 and (np.array(lost) <= [5, 0, 9]).all() and (np.array(lost) >= 0).all()
    assert list(mixing.give_up([], 0, 1)) == []


def brute_targets(sizes, weights, share, repeats):
    aim = [0.0] * len(sizes)
    full = set()
    while True:
        left = share * sum(sizes) - sum(repeats * sizes[i] for i in full)
        w = sum(weights[i % len(weights)] for i in range(len(sizes)) if i not in full)
        over = set()
        for i in range(len(sizes)):
            if i not in full:
                aim[i] = left * weights[i % len(weights)] / w
                if aim[i] > repeats * sizes[i]:
                    over.add(i)
        for i in over:
            aim[i] = repeats * sizes[i]
        full |= over
        if not over:
            return aim


def test_targets_equal_repeated_resharing(spark):
    rng = np.random.RandomState(0)
    for n in (1, 2, 5, 8, 60):
        sizes = [int(x) for x in rng.randint(0, 50, n) ** 2]
        sources = spark.createDataFrame([(f"=s{i:03d}" if i < n - 1 else "", m) for i, m in enumerate(sizes)], "_source string, n long")
        rows = {r["_source"]: r.target for r in mixing.with_targets(sources).collect()}
        got = [rows[f"=s{i:03d}" if i < n - 1 else ""] for i in range(n)]
        assert np.allclose(got, brute_targets(sizes, mixing.WEIGHTS, 1.5, 2)) or sum(sizes) == 0


def test_numbers_and_sums_over_all_rows(spark):
    rows = [(i * 37 % 101, i) for i in range(101)]
    out = mixing.numbered(spark.createDataFrame(rows, "k int, v long"), ["k"], {"before": "v"}).orderBy("k").collect()
    value = dict(rows)
    assert [r.place for r in out] == list(range(101)) and [r.before for r in out] == [sum(value[j] for j in range(k)) for k in range(101)]


def test_slots_of_sources_of_any_size(spark):
    sources = spark.createDataFrame([("=a", 40_000_000, 73_000_000.4, 625_000), ("=b", 10, 15.0, 1), ("=c", 64, 128.0, 1), ("=d", 130, 65.0, 3), ("=e", 0, 0.0, 0)], "_source string, source_size long, target double, blocks long")
    slots = mixing.slots_of(sources, 64, 64, 7)
    size = F.when(F.col("block") == F.col("blocks") - 1, F.col("source_size") - (F.col("blocks") - 1) * 64).otherwise(64)
    taken = slots.join(sources, "_source").groupBy("_source").agg(F.sum(F.coalesce("take", size)).alias("words"), F.count_distinct("slot").alias("n"), F.max("slot").alias("last"), F.count_distinct("shard").alias("shards"))
    got = {r["_source"]: (r.words, r.n - r.last) for r in taken.collect()}
    assert got == {"=a": (73_000_000, 1), "=b": (15, 1), "=c": (128, 1), "=d": (65, 1)}
    shards = [r["count"] for r in slots.where("_source = '=a'").groupBy("shard").count().collect()]
    assert len(shards) == 64 and max(shards) < 1.05 * min(shards)
    twice = slots.groupBy("_source", "pass", "block").count().where("count > 1")
    assert twice.isEmpty()


def test_one_source_with_most_words_and_tiny_ones(spark):
    rows = [(i, "a b c d e f g h i j " * 20, "big", 1) for i in range(400)] + [(1000 + i, "x " * (i + 1), f"tiny{i}", 1) for i in range(6)] + [(2000, "y " * 30_000, None, 1), (None, None, "big", 1), (None, None, "big", 1)]
    out = mixing.mixture_counts(spark.createDataFrame(rows, "doc_id long, text string, source string, target int")).collect()
    taken, target = collections.Counter(), {}
    for r in out:
        taken[r.source_size] += r.taken
        target[r.source_size] = r.target
        assert r.taken <= 2 * r["size"]
    assert len(out) == len(rows) and all(abs(taken[s] - target[s]) <= 1 for s in target)


def test_permutations_are_permutations():
    for n in (1, 2, 3, 17, 64, 1000):
        key = np.full(n, 12345, dtype=np.uint64)
        assert sorted(mixing.permuted(np.arange(n), np.full(n, n), key).tolist()) == list(range(n))


def test_mixture_meets_targets(spark):
    docs = corpora.documents(spark, n=300)
    out = mixing.mixture_counts(docs).collect()
    again = mixing.mixture_counts(docs.repartition(7)).collect()
    assert collections.Counter(map(tuple, out)) == collections.Counter(map(tuple, again))
    rows = corpora.rows(n=300)
    assert len(out) == len(rows)
    assert collections.Counter((r.doc_id, r["size"]) for r in out) == collections.Counter((r[0], len((r[1] or "").split())) for r in rows)
    assert all(0 <= r.taken <= 2 * r["size"] for r in out)
    names = sorted({r[3] for r in rows if r[3] is not None}) + [None]
    sizes = [sum(len((r[1] or "").split()) for r in rows if r[3] == s) for s in names]
    aims = dict(zip(sizes, brute_targets(sizes, mixing.WEIGHTS, 1.5, 2), strict=True))
    taken = collections.Counter()
    for r in out:
        assert abs(r.target - aims[r.source_size]) < 1e-6
        taken[r.source_size] += r.taken
    for size, aim in aims.items():
        assert abs(taken[size] - aim) <= 1
    assert mixing.mixture_counts(corpora.empty(spark)).count() == 0


def test_mixed_documents_hold_the_words_taken(spark):
    docs = corpora.documents(spark, n=300)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    taken = sum(r.taken for r in mixing.mixture_counts(docs).collect())
    rows = mixed.collect()
    assert sum(len(r.text.split()) for r in rows) == taken
    known = collections.defaultdict(set)
    for i, t, *_ in corpora.rows(n=300):
        known[i] |= set((t or "").split())
    assert all(set(r.text.split()) <= known[r.doc_id] and r.n_chars == len(r.text) for r in rows)
    assert mixing.mixed_documents(corpora.empty(spark)).count() == 0


# ---- 1: toxicity


def test_toxicity_chain(spark):
    rng = np.random.RandomState(1)
    vocabulary = [f"word{i}" for i in range(500)]
    rows, labels = [], []
    for i in range(400):
        words = rng.choice(vocabulary, 60 if i != 7 else 60_000).tolist()
        bad, poor = i % 5 == 0, i % 3 == 0
        if bad:
            words[10] = ["idiot", "scum", "Moron", "grobian"][i // 5 % 4]
        if poor:
            words[20] = ["lorem", "click"][i // 3 % 2]
        rows.append((i, " ".join(words)))
        if i < 300:
            labels += [(i, int(not poor) if i % 7 else None, int(bad))] * (1 + i % 2)
    rows += [(900, None), (901, ""), (None, "idiot"), rows[10], rows[10], (10, "another text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("is_toxic", F.lit("taken"))
    known = spark.createDataFrame([*labels, (None, 1, 1), (5, 0, None), *((i, 1, i % 2) for i in range(5000, 9000))], "doc_id long, quality int, toxic int")
    chain = toxicity.train(docs, known)
    out = toxicity.with_toxicity(docs, chain).collect()
    assert len(out) == len(rows)
    held = [r for r in out if r.doc_id is not None and 300 <= r.doc_id < 400]
    assert np.mean([r["_is_toxic"] == (r.doc_id % 5 == 0) for r in held]) > 0.97
    assert np.mean([(r.p_low_quality > 0.5) == (r.doc_id % 3 == 0) for r in held]) > 0.95
    assert all(not r["_is_toxic"] for r in out if not r.text)
    # the later model reads the earlier one's probability
    assert len(chain.weights[1]) == len(chain.weights[0]) + 1
    assert toxicity.train(docs, known.where("toxic = 0")) is None and toxicity.train(docs, known.limit(0)) is None
    assert toxicity.train(docs.limit(0), known) is None
    assert {r["_is_toxic"] for r in toxicity.with_toxicity(docs, None).collect()} == {False}
    assert toxicity.with_toxicity(docs.limit(0), None).count() == 0 and toxicity.with_toxicity(docs.limit(0), chain).count() == 0


def test_later_categories_use_earlier_ones(spark):
    """A category that is only to be seen through another: c is a without b, and b's words are rare."""
    rng = np.random.RandomState(4)
    rows, labels = [], []
    for i in range(600):
        a, b = rng.rand(2) < 0.5
        words = rng.choice([f"w{j}" for j in range(50)], 20).tolist() + ["alpha"] * int(a) + ["beta"] * int(b)
        rows.append((i, " ".join(words)))
        if i < 500:
            labels.append((i, int(a), int(b), int(a and not b)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    categories = (("a", "a = 1"), ("b", "b = 1"), ("c", "c = 1"))
    chain = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, a int, b int, c int"), categories)
    out = toxicity.with_toxicity(docs.where("doc_id >= 500"), chain).collect()
    for name, want in (("p_a", lambda t: "alpha" in t), ("p_b", lambda t: "beta" in t), ("p_c", lambda t: "alpha" in t and "beta" not in t)):
        assert np.mean([(r[name] > 0.5) == want(r.text) for r in out]) > 0.97
    assert chain.categories == ["a", "b", "c"] and "is_c" in out[0]


# ---- 2: personal data

KEY = b"a key for the tests"
VALUES = ["4041894974608795", "4041-8949-7460-8795", "+1 (386) 555-3733", "386-555-3733", "42.144.35.254", "123-45-6789", "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "2021-02-28", "28/02/2021", "12.31.1999", "bosbt.42@mail8.example.com", "+13865553733", "+1 (319) 555-5132"]
INVALID = ["4041894974608796", "999.1.2.3", "000-45-6789", "2021-02-30", "DE88 3704 0044 0532 0130 00", "1234", "123-555-1234"]


@pytest.mark.parametrize("value", VALUES)
def test_pseudonyms_keep_format_and_come_back(value):
    new, found = pii.pseudonymise(f"see {value} here", KEY)
    assert len(found) == 1 and value not in new
    shape = lambda s: re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", re.sub(r"\d", "0", s)))
    if "." not in value or value.count(".") != 3 or "@" in value:
        assert shape(new) == shape(f"see {value} here")
    again, refound = pii.pseudonymise(new, KEY)
    assert [f[0] for f in refound] == [f[0] for f in found]
    assert pii.invert(new, KEY) == f"see {value} here"
    assert pii.pseudonymise(f"see {value} here", key=b"other")[0] != new


@pytest.mark.parametrize("value", INVALID)
def test_what_is_not_valid_stays(value):
    assert pii.pseudonymise(f"see {value} here", KEY)[0] == f"see {value} here"


def test_neighbours_do_not_hide_each_other():
    new, found = pii.pseudonymise("4451718024887799 27.65.93.188, 2021-02-28 386-555-3733", KEY)
    assert [f[0] for f in found] == ["card", "ipv4", "date", "phone"]


def test_equal_values_are_linked_whatever_their_layout():
    digits = lambda t: re.sub(r"\D", "", t)
    a, b = pii.pseudonymise("4041894974608795", KEY)[0], pii.pseudonymise("4041-8949-7460-8795", KEY)[0]
    assert digits(a) == digits(b) and pii.luhn(digits(a))
    assert digits(pii.pseudonymise("386-555-3733", KEY)[0]) == digits(pii.pseudonymise("+1 (386) 555-3733", KEY)[0])[1:]


@pytest.mark.parametrize("value", ["+1 (017) 555-7713", "(123) 155-1234", "1-023-055-1234", "+10175557713", "233.254.104.120", "127.0.0.1", "0.12.3.4", "255.255.255.255"])
def test_values_outside_the_usual_ranges_are_replaced(value):
    new, found = pii.pseudonymise(f"see {value} here", KEY)
    assert len(found) == 1 and value not in new
    assert [f[0] for f in pii.pseudonymise(new, KEY)[1]] == [f[0] for f in found]
    assert pii.invert(new, KEY) == f"see {value} here"


def test_feistel_is_a_permutation():
    for n in (1, 2, 10, 73, 256):
        seen = [pii.feistel(v, n, b"k", "t") for v in range(n)]
        assert sorted(seen) == list(range(n)) and [pii.feistel(v, n, b"k", "t", True) for v in seen] == list(range(n))


def test_pseudonyms_of_awkward_rows(spark):
    docs = corpora.documents(spark)
    out = pii.with_pseudonyms(docs, KEY)
    assert out.columns[: len(docs.columns)] == docs.columns and out.columns[-1] == "_found"
    assert counted(out.select("doc_id", "text")) == counted(docs.select("doc_id", "text"))
    assert pii.with_pseudonyms(corpora.empty(spark), KEY).count() == 0


@pytest.mark.parametrize(
    "text, kept",
    [("ID12 4111 1111 1111 1111", "ID12 "), ("AB12 4111111111111111", "AB12 "), ("4111 1111 1111 1111 123", " 123"), ("BE68 5390 0754 7034 12", " 12"), ("BE68 5390 0754 7034 PAID", " PAID")],
)
def test_a_failed_candidate_hides_nothing(text, kept):
    new, found = pii.pseudonymise(text, KEY)
    assert len(found) == 1 and kept in new and new != text and "1111 1111" not in new and "7034" not in new
    assert pii.invert(new, KEY) == text


def test_all_cards_of_an_independent_scan_are_replaced():
    rng = np.random.RandomState(2)
    for _ in range(300):
        body = "".join(map(str, [rng.randint(3, 7), *rng.randint(0, 10, 14)]))
        card = next(body + str(c) for c in range(10) if pii.luhn(body + str(c)))
        shown = [card, " ".join(card[i : i + 4] for i in range(0, 16, 4)), "-".join(card[i : i + 4] for i in range(0, 16, 4))][rng.randint(3)]
        around = ["AB12", "XY99 1234", "12", "call", "2021-13-45", "1.2.3", "#"]
        text = f"{around[rng.randint(7)]} {shown} {around[rng.randint(7)]}"
        new = pii.pseudonymise(text, KEY)[0]
        assert card not in re.sub(r"[ -]", "", new) or set(card) == {card[0]}


def test_dates_keep_their_reading_and_come_back():
    import datetime

    shift = {}
    for n in range(0, 40_000, 7):
        day = datetime.date(1950, 1, 1) + datetime.timedelta(days=n)
        forms = [day.isoformat(), f"{day.year}/{day.month}/{day.day}", day.strftime("%d.%m.%Y"), f"{day.day}/{day.month}/{day.year}"]
        if day.day > 12:
            forms += [day.strftime("%m/%d/%Y"), f"{day.month}-{day.day}-{day.year}"]
        for form in forms:
            new, found = pii.pseudonymise(form, KEY)
            assert [f[0] for f in found] == ["date"] and len(new) == len(form) and pii.invert(new, KEY) == form
            a = [int(x) for x in re.split(r"[-/.]", new)]
            a = a if a[0] > 31 else [a[2], *((a[0], a[1]) if form in forms[4:] else (a[1], a[0]))]
            # one pseudonym for a day in all layouts
            assert shift.setdefault(day, a) == a


def test_values_are_linked_across_capitals_and_rows(spark):
    a, b = (pii.pseudonymise(x, KEY)[0] for x in ("Bob@x.com", "bob@X.com"))
    assert a.lower() == b.lower() and a[0].isupper()
    rows = [(1, "card 4111 1111 1111 1111 " + "word " * 50_000), (2, "4111-1111-1111-1111"), (3, None), (4, ""), (2, "4111-1111-1111-1111")]
    out = pii.with_pseudonyms(spark.createDataFrame(rows, "doc_id long, text string"), KEY).collect()
    digits = [re.sub(r"[^0-9]", "", r.text) for r in out if r.n_found]
    assert len(digits) == 3 and len(set(digits)) == 1 and [r.n_found for r in out if r.doc_id in (3, 4)] == [0, 0]
    assert [r.text for r in out if r.doc_id == 3] == [None]


def test_the_key_is_the_caller_s(spark):
    spark.conf.set(pii.KEY_SETTING, "secret")
    assert pii.session_key(spark) == b"secret"
    spark.conf.unset(pii.KEY_SETTING)
    assert len(pii.session_key(spark)) == 32 and pii.session_key(spark) == pii.session_key(spark)
