"""Spelling variants against all pairs of words."""

import collections
import random
import re
import zlib

import pytest

from tests.llm import corpora
from tidemark.llm import spelling


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_words(rows):
    counts = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 3}


def plain_forms(words):
    partners = {w: [v for v in words if near(w, v)] for w in words}
    form = {}
    for w, others in partners.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, words[w], len(partners[w]), form[w], words.get(form[w]), root))
    return out


def found(df):
    rows = [(r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def some_words(seed, letters, sizes, n):
    rng = random.Random(seed)
    out = {}
    while len(out) < n:
        w = "".join(rng.choice(letters) for _ in range(rng.choice(sizes)))
        out[w] = rng.choice([3, 5, 9, 20, 45, 100, 400])
        if rng.random() < 0.6:
            at = rng.randrange(len(w))
            out[w[:at] + rng.choice([rng.choice(letters), w[at] * 2, ""]) + w[at + 1 :]] = rng.choice([3, 3, 6, 12])
    return {w: n for w, n in out.items() if w}


@pytest.mark.parametrize(("letters", "sizes"), [("ab", [1, 2, 3, 4, 5, 6, 7]), ("abc\u00e9", [5, 6, 7, 8]), ("ab", [11, 12, 13])])
@pytest.mark.parametrize(("hot", "rows"), [(4096, 32768), (3, 40), (25, 7)])
def test_forms_equal_all_pairs(spark, monkeypatch, letters, sizes, hot, rows):
    """Words that share long halves, in few and in many cuts of the windows."""
    monkeypatch.setattr(spelling, "HOT", hot)
    monkeypatch.setattr(spelling, "TASK_ROWS", rows)
    words = some_words(hot + len(sizes), letters, sizes, 150)
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    assert found(spelling.spelling_forms(table)) == plain_forms(words)


def test_texts_equal_all_pairs(spark):
    rows = corpora.rows(n=90)
    rng = random.Random(8)
    base = [corpora.word(rng) + corpora.word(rng) for _ in range(60)]
    more = [(1000 + i, " ".join(rng.choice([w, w, w.upper(), w[:-1], w + "\u00c0\u00d7", w + "2x"]) for w in rng.choices(base, k=80)) + "-" + "z" * 5000) for i in range(120)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in [(r[0], r[1]) for r in rows] + more], "doc_id long, text string, word string")
    words = plain_words([(r[0], r[1]) for r in rows] + more)
    assert "z" * 5000 in words and len(words) > 60
    want = plain_forms(words)
    assert any(w[3] for w in want) and any(w[3] and w[3] != w[5] for w in want)
    assert found(spelling.spelling_variants(docs)) == want
    assert spelling.spelling_variants(corpora.empty(spark)).count() == 0


def test_automata_number_words_in_order():
    words = sorted(some_words(1, "abc", [1, 2, 5, 6], 300))
    automaton = spelling.Automaton(words)
    assert automaton.words[automaton.start] == len(words)
    for number, word in enumerate(words):
        assert automaton._ends(automaton.start, 0, word, 0) == number
    assert automaton._ends(automaton.start, 0, "abcabcabcabc", 0) == -1
    # minimal: fewer states than prefixes
    assert len(automaton.arcs) < len({w[:i] for w in words for i in range(len(w) + 1)})
