"""Toxicity by a chain of linear classifiers.

Categories are predicted in order; each model sees the text's features and the probabilities of the
categories before it.  In training these probabilities are out-of-fold predictions (models that
have not seen the row, folds by text, so copies stay together); in use they are the chain's own.

The categories are what the labels say of a document, in the order given (CATEGORIES, conditions on the label table); the last
one is what is flagged.  A row without a label for a category does not teach it.

Features: hashed words, and hashed heads of words (their first 4 and 6 bytes, as endings vary), each counted as
present or not.  Spark counts them in the labelled rows; the FEATURES that tell the classes of some category apart
best are kept, so a long text gathers no noise.

The training sample is bounded: TRAIN_ROWS labelled documents of each class of the last category, those with the
smallest hashes of their ids among documents with a text; class weights restore the shares of all labels.  What the
driver receives is at most FEATURES numbers for each of these rows.

Cases: a null or empty text has no features: it gets the models' intercepts, and is flagged never.
With no labels (or an empty table of them), or of one class only, nothing can be learned: all probabilities are 0.  Repeated
label rows of a document count as one, with a category if any has it; of repeated document rows one text teaches (the
smallest hash).  Very long texts are read whole.  No rows give no rows.  All input columns are kept; result columns come
last, with underscores in front where names are taken.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as kit
from .shared import discard, each_batch, free_name, settle, small_batches

#: Categories in the order of the chain, and the labels that mark them.
CATEGORIES = (("low_quality", "quality = 0"), ("toxic", "toxic = 1"))
TRAIN_ROWS = 3000
CELL_BITS = 20
FEATURES = 1024
#: Standard errors by which a feature's shares in the classes must differ to be kept.
SIGNIFICANT = 3.5
HEADS = (4, 6)
FOLDS = 5
FLAG_AT = 0.3


@dataclass
class Chain:
    categories: list[str]
    cells: np.ndarray  #: hashed cell to feature, -1 for none
    weights: list[np.ndarray]  #: of each category: features, then earlier probabilities
    biases: list[float]


def features(words: kit.Words) -> tuple[np.ndarray, np.ndarray]:
    """(document, cell) of each word and head of a block, not yet distinct."""
    doc = words.doc_of_word()
    cells = [words.hashes]
    for number, head in enumerate(HEADS):
        cells.append(kit.splitmix(kit._hash_spans(words.data, words.starts, np.minimum(words.starts + head, words.ends), kit._FOLDED_VALUES), 60 + number))
    cell = np.concatenate(cells) >> kit.U64(64 - CELL_BITS)
    return np.tile(doc, len(cells)), cell.astype(np.int64)


def _distinct(doc: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique((doc << CELL_BITS) | cell)
    return key >> CELL_BITS, key & ((1 << CELL_BITS) - 1)


def _cells_of(batch: pa.RecordBatch):
    """The distinct cells of each text."""
    for words in kit.blocks(batch.column("text"), kit.ALNUM_SPLIT, fold=True):
        doc, cell = _distinct(*features(words))
        rows = pa.array(np.arange(words.first, words.first + words.docs))
        cut = np.searchsorted(doc, np.arange(words.docs + 1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [batch.column("marks").take(rows), batch.column("h").take(rows), pa.ListArray.from_arrays(pa.array(cut), pa.array(cell.astype(np.int32)))], names=["marks", "h", "cells"]
        )


def fit_linear(rows: np.ndarray, cols: np.ndarray, extra: np.ndarray, y: np.ndarray, weight: np.ndarray, n: int, steps: int = 300, l2: float = 1e-5) -> tuple[np.ndarray, float]:
    """Logistic regression on present features (rows, cols) and dense extra columns, by Adam."""
    m = len(y)
    w, bias = np.zeros(n + extra.shape[1]), 0.0
    first, second = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    total = weight.sum()
    for step in range(1, steps + 1):
        z = np.bincount(rows, weights=w[cols], minlength=m) + extra @ w[n:] + bias
        error = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / total
        slope = np.concatenate([np.bincount(cols, weights=error[rows], minlength=n), extra.T @ error, [error.sum()]])
        slope[:-1] += l2 * w
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        move = 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
        w -= move[:-1]
        bias -= move[-1]
    return w, float(bias)


def _probability(rows, cols, extra, m, w, n, bias) -> np.ndarray:
    z = np.bincount(rows, weights=w[cols], minlength=m) + extra @ w[n:] + bias
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def chosen_cells(rows: DataFrame, categories: int) -> list[int]:
    """The cells of (marks, cells) rows that tell the classes of some category apart, the best FEATURES of them."""
    total = rows.agg(*[F.count_if(F.col("marks")[i] == v).alias(f"n{i}_{v}") for i in range(categories) for v in (0, 1)]).first()
    cells = rows.select("marks", F.explode("cells").alias("cell"))
    counts = cells.groupBy("cell").agg(*[F.count_if(F.col("marks")[i] == v).alias(f"c{i}_{v}") for i in range(categories) for v in (0, 1)])
    gaps = []
    for i in range(categories):
        n0, n1 = total[f"n{i}_0"], total[f"n{i}_1"]
        if not n0 or not n1:
            continue
        a, b = F.col(f"c{i}_1"), F.col(f"c{i}_0")
        p = (a + b + 1) / (n0 + n1 + 2)
        gap = F.abs((a + 0.5) / (n1 + 1) - (b + 0.5) / (n0 + 1)) / F.sqrt((p * (1 - p) + 1e-12) * (1 / n1 + 1 / n0))
        gaps.append(F.when(a + b >= 3, gap).otherwise(0.0))
    if not gaps:
        return []
    gap = F.greatest(*gaps) if len(gaps) > 1 else gaps[0]
    best = counts.select("cell", gap.alias("gap")).where(F.col("gap") >= SIGNIFICANT).orderBy(F.desc("gap"), "cell").limit(FEATURES)
    return [r.cell for r in best.collect()]


def learn(categories: list[str], marks: np.ndarray, fold: np.ndarray, cells: list[np.ndarray], chosen: list[int], shares: tuple[float, float]) -> Chain | None:
    """The chain of labelled rows: marks of each row and category (1, 0, or -1 without a label) and its features, numbers
    of chosen cells; shares: of rows without and with the last category among all labels."""
    last = marks[:, -1] == 1
    if not last.any() or last.all():
        return None
    m, n = len(marks), max(1, len(chosen))
    rows = np.repeat(np.arange(m), [len(c) for c in cells])
    cols = np.concatenate(cells).astype(np.int64)
    weight = np.where(last, shares[1] / last.sum(), shares[0] / (~last).sum())
    extra = np.zeros((m, 0))
    weights, biases = [], []
    for number in range(len(categories)):
        y = (marks[:, number] == 1).astype(float)
        own = np.where(marks[:, number] >= 0, weight, 0)
        if not own.any():
            own = weight
        outside = np.zeros(m)
        for f in range(FOLDS):
            seen = fold != f
            if seen.all() or not own[seen].any():
                continue
            w, bias = fit_linear(rows[seen[rows]], cols[seen[rows]], extra, y, np.where(seen, own, 0), n)
            held = ~seen
            outside[held] = _probability(rows, cols, extra, m, w, n, bias)[held]
        w, bias = fit_linear(rows, cols, extra, y, own, n)
        weights.append(w)
        biases.append(bias)
        extra = np.column_stack([extra, outside])
    table = np.full(1 << CELL_BITS, -1, dtype=np.int32)
    table[chosen] = np.arange(len(chosen))
    return Chain(categories, table, weights, biases)


def predict(words: kit.Words, chain: Chain) -> np.ndarray:
    """Probabilities of each document of a block (rows) and category."""
    doc, cell = features(words)
    col = chain.cells[cell]
    some = col >= 0
    doc, col = _distinct(doc[some], col[some].astype(np.int64))
    n = len(chain.weights[0])
    extra = np.zeros((words.docs, 0))
    for w, bias in zip(chain.weights, chain.biases, strict=True):
        extra = np.column_stack([extra, _probability(doc, col, extra, words.docs, w, n, bias)])
    extra[np.diff(words.ptr) == 0] = 0
    return extra


def train(docs: DataFrame, labels: DataFrame, categories=CATEGORIES, id_col: str = "doc_id", text_col: str = "text") -> Chain | None:
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    marks = [F.max(F.expr(condition).cast("int")).alias(f"m{i}") for i, (_, condition) in enumerate(categories)]
    last = f"m{len(categories) - 1}"
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("_label_id")).agg(*marks).where(F.col(last).isNotNull())
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("_label_id"), F.col(text_col).alias("text"))
    shares = {r[last]: r["n"] for r in known.groupBy(last).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not shares.get(0) or not shares.get(1):
        return None
    order = (F.xxhash64("_label_id", F.lit(3)), F.col("_label_id"))
    there = known.join(texts.select("_label_id"), "_label_id", "left_semi")
    # at most 2 * TRAIN_ROWS ids, so they can be broadcast
    sample = there.where(F.col(last) == 1).orderBy(*order).limit(TRAIN_ROWS).unionByName(there.where(F.col(last) == 0).orderBy(*order).limit(TRAIN_ROWS))
    sample = sample.select("_label_id", F.array(*[F.coalesce(f"m{i}", F.lit(-1)) for i in range(len(categories))]).alias("marks"))
    rows = texts.join(F.broadcast(sample), "_label_id").groupBy("_label_id").agg(F.first("marks").alias("marks"), F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = settle(each_batch(_cells_of, "marks array<int>, h long, cells array<int>", rows.select("marks", F.xxhash64("text").alias("h"), "text")))
    chosen = chosen_cells(rows, len(categories))
    table = np.full(1 << CELL_BITS, -1, dtype=np.int32)
    table[chosen] = np.arange(len(chosen))
    shared = spark.sparkContext.broadcast(table)

    def kept(batch: pa.RecordBatch):
        lists = batch.column("cells")
        feature = shared.value[lists.flatten().to_numpy()]
        ends = np.append(0, np.cumsum(feature >= 0))[lists.offsets.to_numpy() - lists.offsets[0].as_py()].astype(np.int32)
        cells = pa.ListArray.from_arrays(pa.array(ends), pa.array(feature[feature >= 0]))
        yield pa.RecordBatch.from_arrays([batch.column("marks"), batch.column("h"), cells], names=["marks", "h", "cells"])

    got = each_batch(kept, "marks array<int>, h long, cells array<int>", rows).toPandas().sort_values("h", kind="stable").reset_index(drop=True)
    shared.destroy()
    discard(rows)
    if got.empty:
        return None
    total = sum(shares.values())
    got = got.iloc[np.lexsort((got["marks"].map(tuple), got["h"]))] if got["h"].duplicated().any() else got
    return learn([c for c, _ in categories], np.array(got["marks"].tolist()), (got["h"] % FOLDS).to_numpy(), [np.asarray(c) for c in got["cells"]], chosen, (shares[0] / total, shares[1] / total))


def with_toxicity(docs: DataFrame, chain: Chain | None, text_col: str = "text", categories=CATEGORIES) -> DataFrame:
    """docs with p_<category> for each category, and is_<the last category>; without a chain the categories are those given."""
    known = chain.categories if chain else [c for c, _ in categories]
    names = [free_name(docs, f"p_{c}") for c in known]
    flag = free_name(docs, f"is_{known[-1]}")
    if chain is None:
        return docs.select(*docs.columns, *[F.lit(0.0).alias(x) for x in names], F.lit(False).alias(flag))
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    @F.pandas_udf("array<double>")
    def judge(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            found = [predict(words, shared.value) for words in kit.blocks(pa.array(part, pa.string()), kit.ALNUM_SPLIT, fold=True)]
            yield pd.Series(list(np.concatenate(found)) if found else [])

    held = free_name(docs, "_found")
    out = docs.withColumn(held, judge.asNondeterministic()(F.col(text_col)))
    last = F.col(held)[len(known) - 1]
    return out.select(*docs.columns, *[F.col(held)[i].alias(x) for i, x in enumerate(names)], (last >= FLAG_AT).alias(flag))
