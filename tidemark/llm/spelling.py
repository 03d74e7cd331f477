"""Spelling variants: words one code point apart, found with forward and backward minimal acyclic automata.

A word's neighbours differ from it at one place (a code point more, less or another).  They agree with it before
the place and after it, so with the first half of the word or with the last.  Words that share a half are brought together:
a forward automaton of the words follows the half exactly from the front, a backward one (of the reversed words) from the
back, and either then completes the word with one error.  The automata are minimal, and each state knows how many words
lie behind each of its arcs; the sum along a path is the number of the word reached, without a table of words.

The place of an error is the length of the common prefix, so each pair has one place, and each window of places
that a half leaves open finds other pairs: no pair is found twice.  A half that more than HOT words share is not enough: its
window is cut in two, and the words are brought together by what lies outside of the smaller windows, again and
again, down to a single place, outside of which a few thousand words of any alphabet can agree.  So a task holds
TASK_ROWS words or a few times HOT more, whatever the words are; no half is gathered whole, and none is capped.

Only neighbours that are longer, or equally long and greater, are taken; what is found holds for both words.

Words of texts are counted text by text in Python and summed in Spark.  Forms are followed to their roots by joins that
double the step each time: a form has at least twice its word's count, so there are few.

Cases: a null text has no words, a null id counts as empty where the id is read; rows that repeat are counted each.  Ties go to
the smaller word by code points.  No words give no rows.  Extra columns are not carried.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .shared import bounded_broadcast, discard, settle, small_batches

#: Words that may share what lies outside of a window, and rows of a task.
HOT, TASK_ROWS = 4096, 32768
#: Distinct words that a counting task holds before it hands them on.
HELD = 200_000
#: Keys that are broadcast at most.
FEW_KEYS = 100_000
RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: Of the runs of letters of a document, every BLURRED-th loses a code point.
BLURRED = 97


# ---- counting


def _lowered(text: str) -> str:
    """A-Z in lower case and nothing else."""
    return text.lower() if text.isascii() else text.encode().lower().decode()


def words_of(doc_id: int | None, text: str, least: int = 5) -> Counter:
    """The words of a text and how often it has them, after the loss of single code points."""
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    found: Counter = Counter()
    for run, n in Counter(RUN.findall(_lowered(text))).items():
        if len(run) >= least:
            h = zlib.crc32(run.encode(), start)
            if h % BLURRED == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
                if len(run) < least:
                    continue
            found[run] += n
    return found


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 5, often: int = 3) -> DataFrame:
    """(word, n) of the words of at least `least` code points that all texts together have `often` times or more."""
    small_batches(docs.sparkSession)

    def count(batches):
        held: Counter = Counter()

        def told():
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if text.is_valid:
                    held.update(words_of(doc_id, text.as_py(), least))
            if len(held) > HELD:
                yield told()
                held.clear()
        yield told()

    texts = docs.select(F.col(id_col), F.col(text_col))
    return texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= often)


# ---- automata


class Automaton:
    """The minimal acyclic automaton of sorted distinct words; arcs[state] maps a code point to the next state and the
    number of words that come before those behind the arc."""

    def __init__(self, words: list[str]):
        self.arcs: list[dict[str, tuple[int, int]]] = []
        self.final: list[bool] = []
        self.words: list[int] = []
        known: dict[tuple, int] = {}
        # of the last word: its code points, each with the arcs of the state that it leaves, and the arcs of its last
        # state; the first entry of arcs tells if a word ends there
        path: list[tuple[list, str]] = []
        arcs: list = [False]

        def state(arcs: list) -> int:
            key = tuple(arcs)
            number = known.get(key)
            if number is None:
                number = known[key] = len(self.arcs)
                before = int(arcs[0])
                table = {}
                for letter, target in arcs[1:]:
                    table[letter] = target, before
                    before += self.words[target]
                self.arcs.append(table)
                self.final.append(arcs[0])
                self.words.append(before)
            return number

        last = ""
        for word in words:
            common = 0
            while common < len(last) and common < len(word) and last[common] == word[common]:
                common += 1
            while len(path) > common:
                above, letter = path.pop()
                above.append((letter, state(arcs)))
                arcs = above
            for letter in word[common:]:
                path.append((arcs, letter))
                arcs = [False]
            arcs[0] = True
            last = word
        while path:
            above, letter = path.pop()
            above.append((letter, state(arcs)))
            arcs = above
        self.start = state(arcs)

    def _ends(self, state: int, number: int, word: str, at: int) -> int:
        """The number of the word that follows word[at:] exactly from the state, or -1."""
        arcs = self.arcs
        for letter in word[at:] if at else word:
            step = arcs[state].get(letter)
            if step is None:
                return -1
            state, before = step
            number += before
        return number if self.final[state] else -1

    def near(self, word: str, exact: int) -> list[tuple[int, int, bool]]:
        """(number, place, longer) of the words that agree with the first `exact` code points and differ by one
        replaced or added code point, at the first place where they differ."""
        state, number, found = self.start, 0, []
        for letter in word[:exact]:
            step = self.arcs[state].get(letter)
            if step is None:
                return found
            state, number = step[0], number + step[1]
        for place in range(exact, len(word) + 1):
            own = word[place] if place < len(word) else ""
            for letter, (target, before) in self.arcs[state].items():
                if letter != own:
                    if own and (other := self._ends(target, number + before, word, place + 1)) >= 0:
                        found.append((other, place, False))
                    if (other := self._ends(target, number + before, word, place) if own else number + before if self.final[target] else -1) >= 0:
                        found.append((other, place, True))
            step = self.arcs[state].get(own)
            if step is None:
                break
            state, number = step[0], number + step[1]
        return found


def _common(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def pairs_of(counts: dict[str, int], asked: list[tuple[str, int, int]]):
    """Pairs of words of `counts` for each asked word and window: the places from `low` to `high` where they may differ."""
    words = sorted(counts)
    forward = backward = None
    for word, low, high in asked:
        tail = max(0, len(word) - high - 1)
        if low >= tail:
            forward = forward or Automaton(words)
            for number, place, longer in forward.near(word, low):
                if place <= high and (longer or word < words[number]):
                    yield word, words[number]
        else:
            if backward is None:
                turned = sorted(w[::-1] for w in words)
                backward = Automaton(turned)
            for number, place, longer in backward.near(word[::-1], tail):
                other = turned[number][::-1]
                if (longer or word < other) and low <= (_common(word, other) if longer else len(word) - 1 - place) <= high:
                    yield word, other


# ---- bringing words together

_KEY = ["length", "low", "high", "head", "tail"]


def _with_outside(rows: DataFrame) -> DataFrame:
    """What lies before and after the window."""
    return rows.withColumns({"head": F.substring("word", F.lit(1), F.col("low")), "tail": F.right("word", F.col("length") - F.col("high") - 1)})


def _placed(words: DataFrame, least: int) -> DataFrame:
    """Each word under both halves of its own length, where its neighbours are looked for, and of the length below."""
    size = F.length("word")

    def halves(length, asks: bool):
        middle = F.floor((length + 1) / 2).cast("int")
        window = lambda low, high: F.struct(length.alias("length"), low.alias("low"), high.alias("high"), F.lit(asks).alias("asks"))
        return window(middle, length), window(F.lit(0), middle - 1)

    windows = F.filter(F.array(*halves(size, True), *halves(size - 1, False)), lambda w: w["asks"] | (w["length"] >= least))
    return _with_outside(words.select("word", "n", F.inline(windows)))


def near_pairs(words: DataFrame, least: int = 1) -> DataFrame:
    """(word, n, near, near_n): each pair of the distinct words of (word, n) that are one code point apart, once: the
    shorter first, or else the smaller.  Words have at least `least` code points."""
    spark = words.sparkSession
    ship(spark)
    rows = settle(_placed(words, least))
    while True:
        sizes = rows.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("rows"))
        facts = sizes.agg(F.sum("rows").alias("rows"), F.count_if(_crowded()).alias("crowded")).first()
        if not facts.crowded:
            break
        hot = bounded_broadcast(sizes.where(_crowded()).select(*_KEY, F.lit(True).alias("cut")), facts.crowded, FEW_KEYS)
        middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
        parts = F.when(F.col("cut"), F.array(F.struct(F.col("low"), middle.alias("high")), F.struct((middle + 1).alias("low"), F.col("high")))).otherwise(F.array(F.struct("low", "high")))
        cut = settle(_with_outside(rows.join(hot, _KEY, "left").select("word", "n", "length", "asks", F.inline(parts))))
        discard(rows)
        rows = cut

    def search(batches):
        counts, asked = {}, []
        for batch in batches:
            for word, n, low, high, asks in zip(*(batch.column(c).to_pylist() for c in ("word", "n", "low", "high", "asks")), strict=True):
                counts[word] = n
                if asks:
                    asked.append((word, low, high))
        found = list(pairs_of(counts, asked))
        for at in range(0, len(found), 10_000):
            part = found[at : at + 10_000]
            left, right = ([p[i] for p in part] for i in (0, 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(left, pa.string()), pa.array([counts[w] for w in left], pa.int64()), pa.array(right, pa.string()), pa.array([counts[w] for w in right], pa.int64())],
                names=["word", "n", "near", "near_n"],
            )

    tasks = -(-(facts.rows or 0) // TASK_ROWS) or 1
    dealt = rows.repartition(tasks, *_KEY).select("word", "n", "low", "high", "asks")
    pairs = settle(dealt.mapInArrow(search, "word string, n long, near string, near_n long"))
    discard(rows)
    return pairs


def _crowded():
    return (F.col("rows") > HOT) & (F.col("low") < F.col("high"))


# ---- forms and roots


def _roots(links: DataFrame) -> DataFrame:
    """(word, root) of links (word, root): each followed to its end by joins that double the step."""
    links = settle(links)
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("_further"))
        joined = settle(links.join(further, "root", "left").select("word", F.coalesce("_further", "root").alias("root"), F.col("_further").isNotNull().alias("moved")))
        discard(links)
        links = joined
        if not links.where("moved").limit(1).count():
            return links.drop("moved")


def spelling_forms(words: DataFrame, least: int = 1) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of distinct words (word, n).

    n_near counts the near words; form is the most frequent one if it is at least twice as frequent as the word.
    """
    words = settle(words)
    pairs = near_pairs(words, least)
    both = pairs.select("word", "near", "near_n").unionByName(pairs.select(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    fits = -F.col("best.less") >= 2 * F.col("n")
    judged = settle(
        words.join(best, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(fits, F.col("best.near")).alias("form"),
            F.when(fits, -F.col("best.less")).alias("form_n"),
        )
    )
    discard(words, pairs)
    roots = _roots(judged.where("form is not null").select("word", F.col("form").alias("root")))
    return judged.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 5, often: int = 3) -> DataFrame:
    """spelling_forms() of the words of all texts."""
    return spelling_forms(word_counts(docs, id_col, text_col, least, often), least)
