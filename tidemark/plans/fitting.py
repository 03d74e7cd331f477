"""Logistic fits of feature rows: ridge-penalised, with class weights, and leave-one-group-out."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT  # noqa: F401  (registers the type)
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scoring import sigmoid
from ..settling import discard, settle
from ..shipping import ship


def fit(rows: DataFrame, features: list[str], label: str, l2: float = 1.0, content_weight: float = 1.0) -> LogisticRegressionModel:
    """rows have the features as columns and a 0/1 label; rows of label 0 weigh content_weight.

    The penalty is l2/2 times the squared coefficients beside the sum of weighted losses; the intercept is free.
    """
    weighted = rows.withColumn("_w", F.when(F.col(label) == 0, float(content_weight)).otherwise(1.0)).withColumn("_y", F.col(label).cast("double"))
    data = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="keep").transform(weighted)
    total = weighted.agg(F.sum("_w")).first()[0] or 1.0
    model = LogisticRegression(featuresCol="_x", labelCol="_y", weightCol="_w", regParam=l2 / total, elasticNetParam=0.0, standardization=False, maxIter=200, tol=1e-10)
    return model.fit(data)


def predicted(model: LogisticRegressionModel, rows: DataFrame, features: list[str], name: str = "p") -> DataFrame:
    data = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="keep").transform(rows)
    return model.transform(data).withColumn(name, vector_to_array("probability")[1]).select(*rows.columns, name)


def weights_document(model: LogisticRegressionModel, rows: DataFrame, features: list[str], edge: str, channel: str = "channel", video: str = "video") -> DataFrame:
    """(json): the coefficients of a fit to four digits, by name, with what it was fitted on; `sources.captions.weights` reads it."""
    named = sorted(zip(features, model.coefficients.toArray().tolist(), strict=True))
    pairs = F.create_map(*[F.lit(x) for name, value in named for x in (name, round(value, 4))])
    facts = rows.agg(F.array_sort(F.collect_set(channel)).alias("trained_on"), F.count_distinct(video).alias("videos"), F.count(F.lit(1)).alias("rows"))
    body = F.struct(F.lit(edge).alias("edge"), F.lit(round(float(model.intercept), 4)).alias("bias"), "trained_on", "videos", "rows", pairs.alias("weights"))
    return facts.select(F.to_json(body).alias("json"))


#: Groups whose models are fitted at once: their coefficients are broadcast and their sums are solved in the driver.
MOST_GROUPS = 20_000
#: Rows that a task takes at a time, and models.
ROWS, MODELS = 2048, 64


def _sums(rows: DataFrame, held: list, w: np.ndarray, content_weight: float) -> np.ndarray:
    """For each model (a row of w, that of the group held[i]): gradient and Hessian of the loss over all rows of other groups."""
    models, d = w.shape
    shared = rows.sparkSession.sparkContext.broadcast((dict(zip(held, range(models), strict=True)), w))

    def partial(batches):
        number, w = shared.value
        gradient, hessian = np.zeros((models, d)), np.zeros((models, d, d))
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x = np.column_stack([np.asarray(part.column(2).flatten(), dtype=np.float64).reshape(part.num_rows, d - 1), np.ones(part.num_rows)])
                y = part.column(1).to_numpy(zero_copy_only=False).astype(np.float64)
                own = np.array([number[g] for g in part.column(0).to_pylist()])
                cost = np.where(y > 0, 1.0, content_weight)[:, None]
                for low in range(0, models, MODELS):
                    p = 1 / (1 + np.exp(-np.clip(x @ w[low : low + MODELS].T, -30, 30)))
                    others = cost * (own[:, None] != np.arange(low, low + p.shape[1])[None, :])
                    gradient[low : low + MODELS] += (others * (p - y[:, None])).T @ x
                    hessian[low : low + MODELS] += np.einsum("ng,ni,nj->gij", others * p * (1 - p), x, x, optimize=True)
        sums = np.concatenate([gradient, hessian.reshape(models, d * d)], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(range(models), pa.int32()), pa.array(sums.tolist(), pa.list_(pa.float64()))], names=["model", "sums"])

    parts = rows.mapInArrow(partial, "model int, sums array<double>").select("model", F.posexplode("sums").alias("place", "part"))
    out = np.zeros((models, d + d * d))
    # a row for each model and entry of its sums
    for r in parts.groupBy("model", "place").agg(F.sum("part").alias("total")).toLocalIterator():
        out[r.model, r.place] = r.total
    shared.destroy()
    return out


def group_models(rows: DataFrame, features: list[str], label: str, group: str, l2: float = 1.0, content_weight: float = 1.0, most_steps: int = 25) -> DataFrame:
    """(group, bias, weights): for each group the ridge fit of all rows of other groups.

    All models take a Newton step at once: one job sums, for each, gradient and Hessian over the rows that it may see.  The
    penalty is that of `fit`.  Steps end when none is over 1e-6.  A null group is one group.  Labels are 0 or 1.
    """
    spark = rows.sparkSession
    ship(spark)
    held = [r[0] for r in rows.select(group).distinct().limit(MOST_GROUPS + 1).collect()]
    if len(held) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups")
    kind = rows.schema[group].dataType.simpleString()
    schema = f"`{group}` {kind}, bias double, weights array<double>"
    if not held:
        return spark.createDataFrame([], schema)
    x = F.array(*[F.col(f).cast("double") for f in features])
    data = settle(rows.select(F.col(group), F.col(label).cast("double").alias("_y"), x.alias("_x")))
    d = len(features) + 1
    ridge = np.diag([l2] * (d - 1) + [0.0])
    w = np.zeros((len(held), d))
    for _ in range(most_steps):
        sums = _sums(data, held, w, content_weight)
        gradient = sums[:, :d] + w @ ridge
        hessian = sums[:, d:].reshape(-1, d, d) + ridge
        # a group without others has no rows to learn from; the intercept then stays where it is
        step = np.stack([np.linalg.lstsq(h, g, rcond=None)[0] for h, g in zip(hessian, gradient, strict=True)])
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    discard(data)
    return spark.createDataFrame([(g, float(m[-1]), [float(v) for v in m[:-1]]) for g, m in zip(held, w, strict=True)], schema)


def leave_group_out(rows: DataFrame, features: list[str], label: str, group: str, l2: float = 1.0, content_weight: float = 1.0) -> DataFrame:
    """Each row with p, its probability by a model that has not seen its group."""
    models = group_models(rows, features, label, group, l2, content_weight).withColumnRenamed(group, "_group")
    z = F.col("bias")
    for i, name in enumerate(features):
        z = z + F.get("weights", i) * F.col(name).cast("double")
    both = rows.join(F.broadcast(models), F.col(group).eqNullSafe(F.col("_group")))  # MOST_GROUPS rows at most
    return both.select(*rows.columns, sigmoid(z).alias("p"))
