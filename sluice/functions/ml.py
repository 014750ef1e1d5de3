"""Models over tables: k-means, least squares, silhouette, remote calls per row."""

from __future__ import annotations

import json
import re
from typing import Callable

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.plans import values as V
from sluice.plans.frame import HIDDEN, Frame
from sluice.plans.values import PipeError
from sluice.runtime import Files, materialize, parts_for, shuffle_partitions

FEATURES = f"{HIDDEN}features"
BLOCK_NUMBERS = 1_000_000  # numbers of the rows in a block of the silhouette
BLOCK_ROWS = 8_000  # rows of such a block at most

#: provider name -> function(text, settings) -> vector or text; set by the user
PROVIDERS: dict[str, dict[str, Callable]] = {"embed": {}, "llm": {}}


def _vectors(f: Frame, on: str | None) -> tuple[DataFrame, list[str]]:
    """Rows with a feature vector; rows with missing values are left out."""
    kinds = f.kinds()
    if on:
        if not isinstance(kinds.get(on), T.ArrayType):
            raise PipeError(f"{on} is no column of vectors")
        v = F.col(f"`{on}`").cast("array<double>")
        sound = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x))
        return f.data.filter(sound).withColumn(FEATURES, array_to_vector(v)), [on]
    names = [n for n, k in kinds.items() if isinstance(k, (*V.INTS, *V.REALS))]
    if not names:
        raise PipeError("no numeric columns")
    return f.data.filter(_complete(names)).withColumn(FEATURES, array_to_vector(F.array(*[F.col(f"`{n}`").cast("double") for n in names]))), names


def _complete(names):
    keep = F.lit(True)
    for n in names:
        keep &= F.col(f"`{n}`").isNotNull() & ~F.isnan(F.col(f"`{n}`").cast("double"))
    return keep


def kmeans(f: Frame, k=3, on: str | None = None, out: str = "cluster", method: str = "silhouette", model: str | None = None) -> Frame:
    """Labels in ``out``; ``k`` a number or a range, of which the best by
    silhouette or by the elbow of the cost is taken."""
    rows, _ = _vectors(f, on)
    if model and Files(f.data.sparkSession, model).exists(model):
        fitted = KMeansModel.load(model)
        best = fitted.summary.k if fitted.hasSummary else len(fitted.clusterCenters())
    else:
        rows = materialize(rows)
        tries = [int(k)] if isinstance(k, int) else [int(x) for x in k]
        made = [(n, KMeans(k=n, seed=42, featuresCol=FEATURES, predictionCol=out, maxIter=50).fit(rows)) for n in tries]
        if len(made) == 1:
            best, fitted = made[0]
        elif method == "elbow":
            cost = [m.summary.trainingCost for _, m in made]
            bend = [cost[i - 1] - 2 * cost[i] + cost[i + 1] for i in range(1, len(cost) - 1)]
            best, fitted = made[1 + int(np.argmax(bend))] if bend else made[0]
        else:
            scores = [_score(m.transform(rows), out) for _, m in made]
            best, fitted = made[int(np.argmax(scores))]
        if model:
            fitted.write().overwrite().save(model)
    base = rows.drop(*[c for c in [out] if c in rows.columns])
    fitted.setPredictionCol(out).setFeaturesCol(FEATURES)
    data = fitted.transform(base).drop(FEATURES)
    return f.with_data(data).with_artifact("kmeans", {"model": fitted, "k": best})


def _score(labelled: DataFrame, label: str) -> float:
    """Exact euclidean silhouette of all rows. Rows are dealt into blocks of
    bounded size; against each block in turn every row sums its distances per
    cluster. Rows without label are left out."""
    spark = labelled.sparkSession
    rows = labelled.select(F.col(label).alias("y"), vector_to_array(F.col(FEATURES)).alias("x")).filter("y is not null")
    rows = materialize(rows.repartition(shuffle_partitions(spark)).withColumn("id", F.monotonically_increasing_id()))
    count = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = sum(count.values())
    if len(count) < 2 or len(count) >= n:
        raise PipeError("silhouette needs at least two clusters and fewer than rows")
    number = {y: k for k, y in enumerate(sorted(count))}
    sizes = np.array([count[y] for y in sorted(count)], float)
    width = max(1, rows.agg(F.max(F.size("x"))).first()[0])
    blocks = parts_for(n, max(1, min(BLOCK_ROWS, BLOCK_NUMBERS // width)))
    sums = None
    for b in range(blocks):
        got = rows.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).collect()
        if not got:
            continue
        block = np.array([r["id"] for r in got]), np.array([number[r["y"]] for r in got]), np.array([r["x"] for r in got], float)
        part = rows.mapInPandas(_distance_sums(spark.sparkContext.broadcast(block), number), "id bigint, own int, c int, s double")
        sums = part if sums is None else sums.unionByName(part)

    def score(frames):
        for pdf in frames:
            own, total = pdf["own"].to_numpy(), np.array(pdf["s"].tolist(), float)
            r = np.arange(len(pdf))
            a, means = total[r, own] / np.maximum(1, sizes[own] - 1), total / sizes
            means[r, own] = np.inf
            b = means.min(1)
            yield pd.DataFrame({"v": np.where(sizes[own] == 1, 0.0, (b - a) / np.maximum(np.maximum(a, b), 1e-300))})

    each = sums.groupBy("id", "own", "c").agg(F.sum("s").alias("s")).groupBy("id", "own").agg(F.sort_array(F.collect_list(F.struct("c", "s"))).s.alias("s"))
    return float(each.mapInPandas(score, "v double").agg(F.avg("v")).first()[0])


def _distance_sums(block, number: dict):
    """Per row and cluster, the sum of the distances to the cluster's rows in a block."""

    def run(frames):
        ids, c, z = block.value
        hot = np.eye(len(number))[c]
        norms = (z * z).sum(1)
        for pdf in frames:
            for s in range(0, len(pdf), 256):
                part = pdf[s : s + 256]
                x, id = np.array(part["x"].tolist(), float), part["id"].to_numpy()
                d = np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] + norms[None, :] - 2 * x @ z.T))
                d[id[:, None] == ids[None, :]] = 0.0
                own = [number[y] for y in part["y"].tolist()]
                k = len(number)
                yield pd.DataFrame({"id": np.repeat(id, k), "own": np.repeat(own, k), "c": np.tile(np.arange(k), len(id)), "s": (d @ hot).ravel()})

    return run


def exact_silhouette(x: np.ndarray, y: np.ndarray) -> float:
    labels = np.unique(y)
    if len(labels) < 2 or len(labels) >= len(y):
        raise PipeError("silhouette needs at least two clusters and fewer than rows")
    sizes = np.array([(y == c).sum() for c in labels])
    own = np.searchsorted(labels, y)
    hot = np.eye(len(labels))[own]
    norms = (x * x).sum(1)
    scores = np.empty(len(y))
    for s in range(0, len(x), 512):
        d = np.sqrt(np.maximum(0, norms[s : s + 512, None] + norms[None, :] - 2 * x[s : s + 512] @ x.T))
        sums = d @ hot
        o = own[s : s + 512]
        r = np.arange(len(o))
        a = sums[r, o] / np.maximum(1, sizes[o] - 1)
        means = sums / sizes
        means[r, o] = np.inf
        b = means.min(1)
        scores[s : s + 512] = np.where(sizes[o] == 1, 0.0, (b - a) / np.maximum(np.maximum(a, b), 1e-300))
    return float(scores.mean())


def silhouette(f: Frame, label: str = "cluster", on: str | None = None) -> float:
    kinds = f.kinds()
    rest = Frame(f.data.select(*[F.col(f"`{c}`") for c in kinds if c != label], F.col(f"`{label}`").alias(f"{HIDDEN}label")))
    rows, _ = _vectors(rest, on)
    return _score(rows, f"{HIDDEN}label")


def ols(f: Frame, on: str, out: str = "prediction", model: str | None = None) -> Frame:
    """Least squares of ``on`` by all other numeric columns; ``model`` names a
    folder from which the fit is loaded if it is there, else where it is saved."""
    kinds = f.kinds()
    names = [n for n, k in kinds.items() if isinstance(k, (*V.INTS, *V.REALS)) and n != on]
    if on not in kinds or not names:
        raise PipeError("ols needs a target and other numeric columns")
    rows = f.data.filter(_complete([*names, on]))
    label = f"{HIDDEN}label"
    ready = VectorAssembler(inputCols=[f"{HIDDEN}x{i}" for i in range(len(names))], outputCol=FEATURES).transform(
        rows.withColumns({f"{HIDDEN}x{i}": F.col(f"`{n}`").cast("double") for i, n in enumerate(names)} | {label: F.col(f"`{on}`").cast("double")})
    )
    if model and Files(f.data.sparkSession, model).exists(model):
        fitted = LinearRegressionModel.load(model).setFeaturesCol(FEATURES).setPredictionCol(out)
    else:
        fitted = LinearRegression(solver="normal", regParam=0.0, featuresCol=FEATURES, labelCol=label, predictionCol=out).fit(ready)
        if model:
            fitted.write().overwrite().save(model)
    data = fitted.transform(ready.drop(*[c for c in [out, "residual"] if c in ready.columns and c != on]))
    data = data.withColumn("residual", F.col(label) - F.col(out)).drop(FEATURES, label, *[f"{HIDDEN}x{i}" for i in range(len(names))])
    coefficients = dict(zip(names, (float(c) for c in fitted.coefficients))) | {"intercept": float(fitted.intercept)}
    return f.with_data(data).with_artifact("ols", {"model": fitted, "r2": _r2(fitted, ready, label, out), "coefficients": coefficients})


def _r2(fitted, ready: DataFrame, label: str, out: str) -> float:
    if fitted.hasSummary:
        return float(fitted.summary.r2)
    return float(fitted.evaluate(ready.drop(*[c for c in [out] if c in ready.columns])).r2)


def umap(f: Frame, dims: int = 2, on: str | None = None, out="umap") -> Frame:
    """UMAP through the ``umap`` package where it is installed; the embedding is
    fitted on the driver, so the rows must be few (at most 100,000)."""
    try:
        import umap as package
    except ImportError:
        raise PipeError("ml.umap needs the umap-learn package, which is not installed") from None
    rows, _ = _vectors(f, on)
    if rows.limit(100_001).count() > 100_000:
        raise PipeError("ml.umap fits at most 100,000 rows")
    rows = materialize(rows.withColumn(f"{HIDDEN}row", F.monotonically_increasing_id()))
    got = rows.select(f"{HIDDEN}row", FEATURES).collect()
    fitted = package.UMAP(n_components=dims, random_state=42).fit(np.array([r[1].toArray() for r in got]))
    names = list(out) if isinstance(out, (list, tuple)) else [f"{out}_{i}" for i in range(dims)]
    table = f.data.sparkSession.createDataFrame([(r[0], *map(float, e)) for r, e in zip(got, fitted.embedding_)], [f"{HIDDEN}row", *names])
    return f.with_data(rows.join(table, f"{HIDDEN}row").drop(f"{HIDDEN}row", FEATURES)).with_artifact("umap", {"model": fitted})


# --- calls to remote models, one per row --------------------------------------------------


def provide(kind: str, name: str, fn: Callable) -> None:
    """Register ``fn(text, settings)`` as the provider ``name`` of ml.embed or ml.llm."""
    PROVIDERS[kind][name] = fn


def parse_reply(text: str):
    """JSON in a reply, with or without a code fence around it."""
    bare = re.sub(r"^\s*```[a-zA-Z]*\s*|\s*```\s*$", "", text)
    json.loads(bare)
    return bare


def remote(kind: str, args: list[V.Val], settings: dict, s) -> V.Val:
    """A provider's function as a row call: Arrow batches, retries, threads."""
    from sluice.plans.compiler import RowFunction, row_call

    name = settings.get("source")
    fn = PROVIDERS[kind].get(name)
    if fn is None:
        raise PipeError(f"ml.{kind}: no provider {name!r} is registered; use ml.provide")
    row_settings = {k: v for k, v in settings.items() if isinstance(v, V.Val)}
    fixed = {k: v for k, v in settings.items() if not isinstance(v, V.Val)}
    as_json = kind == "llm" and fixed.get("format") == "json"

    def call(text, *more):
        reply = fn(text, {**fixed, **dict(zip(row_settings, more))})
        if kind == "embed":
            return [float(x) for x in reply]
        return parse_reply(reply) if as_json else str(reply)

    out = T.ArrayType(T.DoubleType()) if kind == "embed" else T.StringType()
    got = row_call(RowFunction(call, out), [*args, *row_settings.values()], s)
    if as_json:
        return V.Val(F.try_parse_json(got.col), T.VariantType(), got.err)
    return got
