"""Language identification by cross-parsing entropy.

Each language has a text of labelled documents and its suffix automaton.  A document is parsed
greedily into the longest phrases that occur in that text; the language in which it needs the
fewest phrases, normalised as phrases * log2(length of the language's text) / letters, wins.

Texts are read as letters: lower-cased, all else is one blank.  Every letter of the labelled sample
is a symbol; a letter that no language has shown is a phrase alone in all of them, so such letters need
no names.  The automata stand in one packed table (`pack`): the arcs of a state lie at its base plus
the symbol, and each place names the state that it belongs to, so the table grows with the arcs and
not with the alphabet, and thousands of pieces of documents are parsed in step.

A text is cut into pieces of `PIECE` symbols only to be parsed in step.  Each piece is first parsed from
its own start; then the phrase that enters it from the piece before is followed until it ends where a
phrase of the piece begins, from where both parses agree.  The phrases are those of one parse
from the first symbol of the text to its last.

The sample is bounded by rows: SAMPLE_DOCS distinct labelled texts of each language, those with the
smallest hashes, and no more of them than fit into an even share of SAMPLE_TOTAL characters.  A text teaches with
at most STRETCH characters, and with no more than the share: of a longer one a stretch that begins at a place chosen by its
hash.  Of more than MOST_LANGUAGES labels, those on most distinct texts are learned.

score: how much the winner undercuts the runner-up, 1 - best / second (1 if there is one language
only), clipped to [0, 1].  Ties go to the first language by code point.

Cases: a text that is null, empty or without letters is `und` with score 0.  With no labelled
rows at all every text is `und`.  Copies of a labelled text count once.  Very long texts are read whole.  No rows
give no rows.  All columns of the input are kept; the result columns come last and get
underscores in front if their names are taken.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shipping import ship
from .shared import free_name, give_back, small_batches

UNDETERMINED = "und"
#: Bound of the labelled sample: languages, texts for each, characters of each text, and characters in all, which the
#: languages share evenly.
MOST_LANGUAGES, SAMPLE_DOCS, STRETCH, SAMPLE_TOTAL = 500, 24, 8000, 400_000
PIECE = 256
#: So few parses are gone on with one by one and not in step.
FEW = 24
#: Characters that are parsed at a time.
BLOCK_CHARS = 1 << 19
_CODE_POINTS = 0x110000


@dataclass
class Model:
    languages: list[str]
    symbols: np.ndarray  #: code point to symbol: 0 blank, 1.. letters of the sample, the last one all others
    base: np.ndarray  #: of each state: where its arcs lie
    owner: np.ndarray  #: of each place: the state whose arc lies there
    target: np.ndarray  #: of each place: the state that the arc leads to
    roots: np.ndarray  #: start state of each language
    bits: np.ndarray  #: log2 of the length of each language's text
    width: int  #: number of symbols

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The next states; 0 where a state has no such arc."""
        at = self.base[state] + symbol
        return np.where(self.owner[at] == state, self.target[at], 0)


def suffix_automaton(text: list[int]) -> list[dict[int, int]]:
    """Arcs of the smallest automaton of all substrings; state 1 is the start, state 0 is none."""
    moves: list[dict[int, int]] = [{}, {}]
    link, length, last = [0, 0], [0, 0], 1
    for symbol in text:
        new = len(moves)
        moves.append({})
        link.append(1)
        length.append(length[last] + 1)
        p = last
        while p and symbol not in moves[p]:
            moves[p][symbol] = new
            p = link[p]
        if p:
            q = moves[p][symbol]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(moves)
                moves.append(dict(moves[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                link[q] = link[new] = twin
                while p and moves[p].get(symbol) == q:
                    moves[p][symbol] = twin
                    p = link[p]
        last = new
    return moves


def pack(moves: list[dict[int, int]], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base, owner, target): arcs of all states in one array, each state's at its base plus the symbol."""
    arcs = sum(len(m) for m in moves)
    free = np.ones(width + 2 * arcs + width * 64, dtype=bool)
    base = np.zeros(len(moves), dtype=np.int64)
    owner = np.zeros(len(free), dtype=np.int32)
    target = np.zeros(len(free), dtype=np.int32)
    many = sorted((s for s in range(len(moves)) if len(moves[s]) > 1), key=lambda s: -len(moves[s]))
    low = width  # no place before it is searched any more
    for state in many:
        symbols = np.array(sorted(moves[state]), dtype=np.int64)
        at, chosen = low, -1
        while chosen < 0:
            if at + 1024 + width > len(free):
                grown = len(free)
                free = np.append(free, np.ones(grown, dtype=bool))
                owner, target = (np.append(x, np.zeros(grown, dtype=np.int32)) for x in (owner, target))
            window = at + np.flatnonzero(free[at : at + 1024])
            fits = free[(window - symbols[0])[:, None] + symbols].all(axis=1)
            if fits.any():
                chosen = int(window[np.argmax(fits)] - symbols[0])
            at += 1024
        if at - low > 8 * 1024:
            low += 1024
        places = chosen + symbols
        base[state] = chosen
        free[places] = False
        owner[places] = state
        target[places] = [moves[state][c] for c in symbols.tolist()]
    # a state with one arc takes any place that is left
    single = np.array([s for s in range(len(moves)) if len(moves[s]) == 1], dtype=np.int64)
    room = width + np.flatnonzero(free[width:])
    if len(room) < len(single):
        room = np.append(room, len(free) + np.arange(len(single) - len(room)))
    places = room[: len(single)]
    size = max(len(free), int(places.max(initial=0)) + 1) + width
    owner, target = (np.append(x, np.zeros(size - len(x), dtype=np.int32)) for x in (owner, target))
    arc = [next(iter(moves[s].items())) for s in single.tolist()]
    symbols = np.array([c for c, _ in arc], dtype=np.int64)
    base[single] = places - symbols
    owner[places] = single
    target[places] = [to for _, to in arc]
    used = max(int(places.max(initial=0)), int(np.flatnonzero(owner).max(initial=0))) + 1
    size = max(used, int(base.max()) + width)
    return base, owner[:size], target[:size]


_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.array([chr(c).isalpha() for c in range(_CODE_POINTS)]))
    return _LETTERS[0]


def _points(texts: list[str]) -> np.ndarray:
    """Code points of the lower-cased texts, a zero after each."""
    return np.frombuffer("".join(t.lower().replace("\0", " ") + "\0" for t in texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _read(texts: list[str], symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, runs of blanks as one blank, and the end of each text in them."""
    points = _points(texts)
    codes = symbols[points]
    end = points == 0
    keep = (codes != 0) | np.append(False, codes[:-1] != 0)
    keep |= end
    ends = np.flatnonzero(end[keep])
    return codes[keep], ends


def coded(sample: list[tuple[str, str]]) -> tuple[np.ndarray, int, list[tuple[str, np.ndarray]]]:
    """Of (language, text) rows: code point to symbol, the number of symbols, and each language's text in symbols."""
    texts: dict[str, list[str]] = {}
    for language, text in sorted(sample):
        texts.setdefault(language, []).append(text)
    letters = _letters()
    seen = np.zeros(_CODE_POINTS, dtype=bool)
    for rows in texts.values():
        seen[_points(rows)] = True
    seen &= letters
    count = int(seen.sum())
    symbols = np.zeros(_CODE_POINTS, dtype=np.int32)
    symbols[letters] = count + 1
    symbols[seen] = 1 + np.arange(count)
    read = [(language, _read(rows, symbols)[0]) for language, rows in texts.items()]
    return symbols, count + 2, [(language, codes) for language, codes in read if (codes != 0).any()]


def automaton(codes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The packed automaton of one language's text."""
    return pack(suffix_automaton(codes.tolist()), width)


def together(symbols: np.ndarray, width: int, texts: list[tuple[str, np.ndarray]], packed: Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Model | None:
    """The model of languages' texts and their packed automata, which stand one after the other in its table."""
    bases, owners, targets, roots = [np.zeros(1, dtype=np.int64)], [], [], []
    states, places = 0, 0
    for base, owner, target in packed:
        # state 0, of which there is one, is none
        bases.append(base[1:].astype(np.int64) + places)
        owners.append(np.where(owner > 0, owner + np.int32(states), np.int32(0)))
        targets.append(np.where(target > 0, target + np.int32(states), np.int32(0)))
        roots.append(states + 1)
        states, places = states + len(base) - 1, places + len(owner)
    bits = [np.log2(max(2, len(codes))) for _, codes in texts]
    return Model([x for x, _ in texts], symbols, np.concatenate(bases), np.concatenate(owners), np.concatenate(targets), np.array(roots), np.array(bits), width) if texts else None


def learn(sample: list[tuple[str, str]]) -> Model | None:
    """The model of (language, text) rows."""
    symbols, width, texts = coded(sample)
    return together(symbols, width, texts, [automaton(codes, width) for _, codes in texts])


def learn_in_tasks(spark: SparkSession, sample: list[tuple[str, str]]) -> Model | None:
    """learn(), each language's automaton by a task: while it is made, it takes many times the memory of the packed one."""
    symbols, width, texts = coded(sample)
    if not texts:
        return None
    ship(spark)

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for n, codes in zip(part["n"], part["codes"], strict=True):
                made = automaton(np.frombuffer(codes, dtype=np.int32), width)
                yield pd.DataFrame([[n, *(x.astype(np.int32).tobytes() for x in made)]], columns=["n", "base", "owner", "target"])
                give_back()

    rows = spark.createDataFrame([(n, codes.astype(np.int32).tobytes()) for n, (_, codes) in enumerate(texts)], "n int, codes binary")
    tasks = min(len(texts), spark.sparkContext.defaultParallelism)
    # a row for each of MOST_LANGUAGES, of SAMPLE_TOTAL symbols in all
    made = rows.repartition(tasks).mapInPandas(work, "n int, base binary, owner binary, target binary").collect()
    packed = (tuple(np.frombuffer(x, dtype=np.int32) for x in r[1:]) for r in sorted(made, key=lambda r: r.n))
    return together(symbols, width, texts, packed)


def _followed(model: Model, codes: np.ndarray, state: np.ndarray, at: np.ndarray, end: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Where the phrases that are open in these states end, at the end of their texts at last."""
    out = at.copy()
    open_ = np.flatnonzero((state != root) & (at < end))
    state = state[open_]
    while len(open_):
        state = model.step(state, codes[out[open_]])
        on = state > 0
        open_, state = open_[on], state[on]
        out[open_] += 1
        on = out[open_] < end[open_]
        open_, state = open_[on], state[on]
    return out


def _swept(model: Model, codes: np.ndarray, first: np.ndarray, n: int, text: np.ndarray, end: np.ndarray, language: np.ndarray, piece: np.ndarray, at: np.ndarray, state: np.ndarray) -> None:
    """Corrects the marks from each of these places, in the state that the parse has there, until the marks agree with it.

    A text is gone through once for each language: a parse that gets to the place of the next takes that one's place.
    """
    base, owner, target, symbols, marks = (memoryview(x) for x in (model.base, model.owner, model.target, codes, first.view(np.uint8)))
    order = np.lexsort((piece, text[piece], language))
    rows = [(int(language[i]), int(text[piece[i]]), int(at[i]), int(state[i]), int(end[piece[i]])) for i in order]
    i = 0
    while i < len(rows):
        own, doc, place, here, stop = rows[i]
        root, offset = int(model.roots[own]), own * n
        i += 1
        after = rows[i][2] if i < len(rows) and rows[i][:2] == (own, doc) else n
        while True:
            while place >= after:
                # the marks of the parse that is left out end here: what a later one cleared is cleared already
                i += 1
                after = rows[i][2] if i < len(rows) and rows[i][:2] == (own, doc) else n
            if place >= stop:
                break
            symbol = symbols[place]
            j = base[here] + symbol
            now = target[j] if owner[j] == here else 0
            if now and here != root:
                marks[offset + place] = 0
            else:
                if marks[offset + place]:
                    break
                marks[offset + place] = 1
                if not now:
                    j = base[root] + symbol
                    now = target[j] if owner[j] == root else root
            here = now
            place += 1


def phrases(codes: np.ndarray, ends: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Phrases of each text in each language, and the letters of each text."""
    starts = np.append(0, ends[:-1] + 1)
    size = ends - starts
    many, n = len(model.roots), len(codes)
    if not len(size):
        return np.zeros((many, 0), dtype=np.int64), np.zeros(0, dtype=np.int64)
    inside = np.append(codes != 0, False)
    letters = np.where(size > 0, np.add.reduceat(inside.astype(np.int64), starts), 0)
    codes = codes.astype(np.int64)
    pieces = -(-size // PIECE)
    text = np.repeat(np.arange(len(size)), pieces)
    begin = starts[text] + (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * PIECE
    end = ends[text]
    stop = np.minimum(begin + PIECE, end)
    # each piece from its own start, the longest first, so that those still going are in front
    order = np.argsort(begin - stop, kind="stable")
    length = (stop - begin)[order]
    first = np.zeros((many, n), dtype=bool)  # a phrase of the language begins here
    flat, rows = first.ravel(), np.arange(many)[:, None] * n
    root = model.roots[:, None]
    # a symbol that the language has never seen is a phrase alone
    fresh = model.step(root, np.arange(model.width)[None, :])
    fresh = np.where(fresh > 0, fresh, root)
    state = np.repeat(root, len(order), axis=1)
    live = len(order)
    for k in range(int(length[0]) if live else 0):
        live = int(np.searchsorted(-length, -k, side="left"))
        at = begin[order[:live]] + k
        symbol = codes[at]
        before = state[:, :live]
        now = model.step(before, symbol)
        over = now == 0
        # a phrase begins where none is open and where the open one can't go on
        flat[rows + at] = over | (before == root)
        state[:, :live] = np.where(over, fresh[:, symbol], now)
    left = np.empty_like(state)
    left[:, order] = state
    lane = lambda x: np.tile(x, many)
    roots = np.repeat(model.roots, len(begin))
    leaves = _followed(model, codes, left.ravel(), lane(stop), lane(end), roots)
    # what enters from the piece before, until both parses begin a phrase at one place
    joined = np.append(False, text[1:] == text[:-1])
    lanes = np.flatnonzero(lane(joined))
    language, piece = np.divmod(lanes, len(begin))
    at, upto, own = leaves[lanes - 1], stop[piece], model.roots[language]
    here = own.copy()
    gone = np.minimum(at, upto) - begin[piece]
    flat[np.repeat(language * n + begin[piece] - np.cumsum(gone) + gone, gone) + np.arange(gone.sum())] = False
    late = at >= upto
    waiting = [(language[late], piece[late], at[late], here[late])]
    on = ~late
    while len(at):
        language, piece, at, upto, own, here = (x[on] for x in (language, piece, at, upto, own, here))
        if len(at) <= FEW:
            break
        symbol = codes[at]
        now = model.step(here, symbol)
        begins = (now == 0) | (here == own)
        place = language * n + at
        met = begins & flat[place]
        flat[place] = begins
        here = np.where(now > 0, now, fresh[language, symbol])
        at = at + 1
        past = ~met & (at == upto)
        if past.any():
            waiting.append((language[past], piece[past], at[past], here[past]))
        on = ~met & ~past
    waiting.append((language, piece, at, here))
    _swept(model, codes, flat, n, text, end, *(np.concatenate(x) for x in zip(*waiting, strict=True)))
    total = np.where(size > 0, np.add.reduceat(np.append(first, np.zeros((many, 1), dtype=bool), axis=1).astype(np.int64), starts, axis=1), 0)
    return total, letters


def classify(texts: list[str], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Language number (-1: undetermined) and score of each text."""
    codes, ends = _read(texts, model.symbols)
    count, letters = phrases(codes, ends, model)
    cost = count * model.bits[:, None] / np.maximum(letters, 1)
    best = np.argmin(cost, axis=0)
    score = np.ones(len(texts))
    if len(model.bits) > 1:
        low = np.sort(cost, axis=0)
        score = np.clip(1 - low[0] / np.maximum(low[1], 1e-12), 0, 1)
    return np.where(letters > 0, best, -1), np.where(letters > 0, score, 0.0)


def labelled_sample(docs: DataFrame, text: Column, language: Column) -> list[tuple[str, str]]:
    """The bounded sample: (language, stretch of a text).

    Texts are counted and ranked by their hashes, one for each distinct text; the stretches of those that are chosen
    are read after that.
    """
    rows = docs.where(text.isNotNull() & language.isNotNull()).select(language.alias("language"), F.xxhash64(text).alias("h"), text.alias("sample"))
    once = rows.groupBy("language", "h").agg(F.least(F.max(F.length("sample")), F.lit(STRETCH)).alias("chars"))
    learned = once.groupBy("language").agg(F.count(F.lit(1)).alias("texts")).orderBy(F.desc("texts"), "language").limit(MOST_LANGUAGES)
    by = Window.partitionBy("language").orderBy("h")
    ranked = once.join(F.broadcast(learned), "language").withColumn("n", F.row_number().over(by)).where(F.col("n") <= SAMPLE_DOCS)
    # SAMPLE_DOCS rows for each of MOST_LANGUAGES
    known = ranked.select("language", "h", "n", F.sum("chars").over(by).alias("upto")).collect()
    share = SAMPLE_TOTAL // max(1, len({r.language for r in known}))
    chosen = [(r.language, r.h) for r in known if r.n == 1 or r.upto <= share]
    if not chosen:
        return []
    wanted = F.broadcast(docs.sparkSession.createDataFrame(chosen, "language string, h long"))
    size = min(STRETCH, share)
    start = F.pmod("h", F.greatest(F.length("sample") - size + 1, F.lit(1))).cast("int") + 1
    found = rows.join(wanted, ["language", "h"]).select("language", "h", F.substring("sample", start, F.lit(size)).alias("sample"))
    return [(r.language, r.sample) for r in found.groupBy("language", "h").agg(F.min("sample").alias("sample")).collect()]


def with_language(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score."""
    pred, score = free_name(docs, "lang_pred"), free_name(docs, "score")
    if model is None:
        return docs.withColumn(pred, F.lit(UNDETERMINED)).withColumn(score, F.lit(0.0))
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def judge(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        held = shared.value
        names = np.array([*held.languages, UNDETERMINED], dtype=object)
        # the marks of a block take a byte for each language and character
        limit = max(1, 4 * BLOCK_CHARS // (3 + len(held.languages)))
        for part in parts:
            texts = part.fillna("").tolist()
            langs, scores = [], []
            at = 0
            while at < len(texts):
                upto, chars = at, 0
                while upto < len(texts) and (upto == at or chars + len(texts[upto]) <= limit):
                    chars += len(texts[upto])
                    upto += 1
                lang, value = classify(texts[at:upto], held)
                langs.append(names[lang])
                scores.append(value)
                at = upto
            yield pd.DataFrame({"lang": np.concatenate(langs) if langs else [], "score": np.concatenate(scores) if scores else []})

    # a filter on what it returns must not make it run twice
    found = free_name(docs, "_found")
    judged = docs.withColumn(found, judge.asNondeterministic()(F.col(text_col)))
    return judged.select(*docs.columns, F.col(f"{found}.lang").alias(pred), F.col(f"{found}.score").alias(score))


def fold(id_col: Column) -> Column:
    """The fold of a document: crc32 of its id's text, mod 4; fold 2 is held out."""
    return F.crc32(id_col.cast("string").cast("binary")) % 4


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs with held_out, lang_pred and score; learned from labelled documents outside the held-out fold.

    A document without an id is not held out (and not learned from).
    """
    held = F.coalesce(fold(F.col(id_col)) == 2, F.lit(False))
    sample = labelled_sample(docs.where(F.col(id_col).isNotNull() & ~held), F.col(text_col), F.col(lang_col))
    out = with_language(docs.withColumn(free_name(docs, "held_out"), held), learn_in_tasks(docs.sparkSession, sample), text_col)
    give_back()
    return out
