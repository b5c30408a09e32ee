"""Direct multi-horizon linear models fitted from sufficient statistics.

One model per key (a series, or a series within a fold) maps an input
vector ``f`` (48 scaled lags, optionally followed by calendar features) to
all ``q`` horizons at once.  The fit needs only
``n, sum(f), sum(y), f'f, f'y`` per key:

1. ``mapInPandas`` over partitions sorted by key (a local sort, no shuffle)
   streams the rows and emits ONE partial statistics vector per key and
   partition, computed with numpy on Arrow batches.
2. The vectors, cut into 64-wide chunks, are summed with built-in
   ``sum`` aggregates keyed by ``(key, chunk)``: map-side combine, and the
   reduction key spreads a hot series over many reducers.
3. A per-key solve (``mapInPandas`` again) turns the summed statistics into
   intercepts and coefficients.  Its input is one row per key, sized by the
   model width, never by the data; one eigendecomposition per key serves all
   penalties of a grid.

Penalties (ridge ``l2`` per feature family) enter only in step 3, so a
parameter grid multiplies neither the data nor the decomposition.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourglass.functions.numeric import clip_floor
from hourglass.operators.joins import SALTS, grid_rows


def _tri(p: int) -> int:
    return p * (p + 1) // 2


def _stats_len(p: int, q: int) -> int:
    # f'f is symmetric: only its upper triangle (row-major) is carried.
    return 1 + p + q + _tri(p) + p * q


CHUNK = 64


def partial_stats(df: DataFrame, keys: Sequence[str], p: int, q: int, f: str = "f",
                  y: str = "y", whole: bool = False) -> DataFrame:
    """Per (key, partition): ``stats = [n, sum f, sum y, upper triangle of f'f, f'y]`` (row-major).

    The vector is emitted as fixed-width chunks, rows ``(keys, chunk, v0..v63)``,
    so the element-wise sum downstream is plain column ``sum``s.  ``whole``
    emits ``(keys, stats)`` instead: for samples partitioned by ``keys``, whose
    vectors need no further sum.
    """
    keys = list(keys)
    key_fields = [df.schema[k] for k in keys]
    schema = T.StructType(key_fields + [T.StructField("chunk", T.IntegerType())]
                          + [T.StructField(f"v{j}", T.DoubleType()) for j in range(CHUNK)])
    if whole:
        schema = T.StructType([*key_fields, T.StructField("stats", T.ArrayType(T.DoubleType()))])
    width = _stats_len(p, q)
    n_chunks = -(-width // CHUNK)
    iu = np.triu_indices(p)
    t = _tri(p)

    def emit(key_rows, stats):
        if whole:
            return pd.DataFrame([(*k, v) for k, v in zip(key_rows, stats, strict=True)], columns=schema.names)
        return _frame(keys, key_rows, stats, n_chunks)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cur_key, acc = None, None
        out_keys, out_stats = [], []

        def flush():
            if cur_key is not None:
                out_keys.append(cur_key)
                out_stats.append(acc.copy())

        for pdf in batches:
            if pdf.empty:
                continue
            # Rows arrive sorted by key; groupby keeps that order within the batch.
            for k, g in pdf.groupby(keys, sort=False, dropna=False):
                k = k if isinstance(k, tuple) else (k,)
                X = np.asarray(np.stack(g[f].to_numpy()), dtype=np.float64).reshape(len(g), p)
                Y = np.asarray(np.stack(g[y].to_numpy()), dtype=np.float64).reshape(len(g), q)
                ok = np.isfinite(X).all(axis=1) & np.isfinite(Y).all(axis=1)
                X, Y = X[ok], Y[ok]
                if k != cur_key:
                    flush()
                    cur_key, acc = k, np.zeros(n_chunks * CHUNK)
                acc[0] += len(X)
                acc[1:1 + p] += X.sum(axis=0)
                acc[1 + p:1 + p + q] += Y.sum(axis=0)
                acc[1 + p + q:1 + p + q + t] += (X.T @ X)[iu]
                acc[1 + p + q + t:width] += (X.T @ Y).ravel()
            # Emit finished keys batch by batch so memory stays O(one key).
            if out_keys:
                yield emit(out_keys, out_stats)
                out_keys, out_stats = [], []
        flush()
        if out_keys:
            yield emit(out_keys, out_stats)

    return df.select(*keys, f, y).sortWithinPartitions(*keys).mapInPandas(run, schema)


def _frame(keys, key_rows, stats, n_chunks):
    m = np.stack(stats).reshape(len(stats) * n_chunks, CHUNK)
    d = {k: np.repeat(np.array([kr[i] for kr in key_rows], dtype=object), n_chunks)
         for i, k in enumerate(keys)}
    d["chunk"] = np.tile(np.arange(n_chunks, dtype=np.int32), len(stats))
    for j in range(CHUNK):
        d[f"v{j}"] = m[:, j]
    return pd.DataFrame(d)


def summed_stats(partials: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Chunk-wise sum of the partial vectors per key with built-in ``sum`` aggregates.

    Keyed by ``(key, chunk)``: map-side combine, and the chunks of a hot key
    go to different reducers.  The per-key gather at the end holds
    ``width / 64`` rows, a size fixed by the model.
    """
    keys = list(keys)
    vals = [f"v{j}" for j in range(CHUNK)]
    summed = partials.groupBy(*keys, "chunk").agg(*[F.sum(v).alias(v) for v in vals])
    packed = summed.select(*keys, F.struct("chunk", F.array(*vals).alias("a")).alias("c"))
    return packed.groupBy(*keys).agg(
        F.flatten(F.transform(F.array_sort(F.collect_list("c")), lambda s: s["a"])).alias("stats"))


def _unpack(stats: np.ndarray, p: int, q: int):
    stats = stats[:_stats_len(p, q)]
    t = _tri(p)
    n = stats[0]
    sx = stats[1:1 + p]
    sy = stats[1 + p:1 + p + q]
    upper = np.zeros((p, p))
    upper[np.triu_indices(p)] = stats[1 + p + q:1 + p + q + t]
    xtx = upper + upper.T - np.diag(np.diag(upper))
    xty = stats[1 + p + q + t:].reshape(p, q)
    return n, sx, sy, xtx, xty


def solve_ridge(stats: np.ndarray, p: int, q: int, penalties: Sequence[np.ndarray]):
    """Ridge with an unpenalized intercept, ``(S_ff + diag(penalty)) b = S_fy``, for every penalty vector.

    Penalties that are multiples of one another share one eigendecomposition
    of the scaled matrix, so a further config of a grid costs two products.  A
    penalty with a zero is solved directly.
    """
    n, sx, sy, xtx, xty = _unpack(stats, p, q)
    if n < 1:
        return
    mx, my = sx / n, sy / n
    sxx = xtx - n * np.outer(mx, mx)
    sxy = xty - n * np.outer(mx, my)
    known: dict[bytes, tuple] = {}
    for penalty in penalties:
        if p and penalty.min() > 0:
            scale = (penalty / penalty[0]) ** -0.5
            if scale.tobytes() not in known:
                values, vectors = np.linalg.eigh(sxx * np.outer(scale, scale))
                known[scale.tobytes()] = (np.maximum(values, 0.0), scale[:, None] * vectors, vectors.T @ (scale[:, None] * sxy))
            values, vectors, turned = known[scale.tobytes()]
            coef = vectors @ (turned / (values + penalty[0])[:, None])
        else:
            a = sxx + np.diag(penalty)
            try:
                coef = np.linalg.solve(a, sxy)
            except np.linalg.LinAlgError:
                coef = np.linalg.lstsq(a, sxy, rcond=None)[0]
        yield my - mx @ coef, coef


def solve(summed: DataFrame, keys: Sequence[str], p: int, q: int, families: Sequence[int] | None = None,
          param_cols: Sequence[str] = ("l2",), configs: Sequence[dict] = ({"l2": 1.0},)) -> DataFrame:
    """Model rows ``(keys, config columns, horizon, intercept, coef, fmean, n)`` per key and config.

    ``coef`` is in the unit of the inputs, ``fmean`` the training mean of each input.

    ``families`` splits the ``p`` features into consecutive blocks, each
    with its own penalty column of ``param_cols`` (two-family model).
    """
    keys, families = list(keys), list(families) if families else [p]
    if sum(families) != p:
        raise ValueError("families must add up to p")
    names = list(configs[0])
    params = [T.StructField(c, T.StringType() if isinstance(configs[0][c], str) else T.DoubleType() if isinstance(configs[0][c], float) else T.LongType()) for c in names]
    schema = T.StructType([summed.schema[k] for k in keys] + params + [
        T.StructField("horizon", T.IntegerType()),
        T.StructField("intercept", T.DoubleType()),
        T.StructField("coef", T.ArrayType(T.DoubleType())),
        T.StructField("fmean", T.ArrayType(T.DoubleType())),
        T.StructField("n", T.LongType())])
    penalties = [np.concatenate([np.full(size, float(c[name])) for size, name in zip(families, param_cols)]) for c in configs]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for rec in pdf.itertuples(index=False):
                r = rec._asdict()
                stats = np.asarray(r["stats"], dtype=np.float64)
                fmean = (stats[1:1 + p] / max(stats[0], 1.0)).tolist()
                for config, (b0, coef) in zip(configs, solve_ridge(stats, p, q, penalties)):
                    rows += [(*[r[k] for k in keys], *[config[c] for c in names], h, float(b0[h]), coef[:, h].tolist(), fmean, int(stats[0])) for h in range(q)]
            if rows:
                yield pd.DataFrame(rows, columns=schema.names)

    return summed.mapInPandas(run, schema)


BUCKET_WINDOWS = 256


def fit_direct(samples: DataFrame, keys: Sequence[str], p: int, q: int, grid: DataFrame | Sequence[dict] | None = None,
               l2: float = 1.0, families: Sequence[int] | None = None,
               param_cols: Sequence[str] = ("l2",), window: str | None = None, windows: int | None = None) -> DataFrame:
    """Fit one direct model per key (and per grid config) on samples with ``f`` and ``y`` arrays.

    With ``window`` the samples are first dealt by key and run of
    ``BUCKET_WINDOWS`` windows: a short series then emits one statistics
    vector instead of one per task (a vector is some 30 times as wide as a
    sample), and a long series is still split over its runs.  Where the caller
    knows that there are ``windows`` windows and they fit one run, a key is
    solved in the task that has its samples, and no vector is shuffled.
    """
    configs = grid_rows(grid) if grid is not None else [{c: float(l2) for c in param_cols}]
    if window is not None and windows is not None and windows <= BUCKET_WINDOWS:
        summed = partial_stats(samples.select(*keys, "f", "y").repartition(*keys), keys, p, q, whole=True)
        return solve(summed, keys, p, q, families, param_cols, configs)
    if window is not None:
        run = F.floor(F.col(window) / F.lit(BUCKET_WINDOWS))
        samples = samples.select(*keys, "f", "y", run.alias("_run")).repartition(*keys, "_run")
    summed = summed_stats(partial_stats(samples, keys, p, q), keys)
    return solve(summed, keys, p, q, families, param_cols, configs)


def predict_direct(samples: DataFrame, model: DataFrame, keys: Sequence[str],
                   window: str = "window_id", clip: bool = True, f: str = "f", carry: Sequence[str] = (),
                   windows: int | None = None) -> DataFrame:
    """``(keys, model params, window, carry, horizon, prediction, target)``: a join plus array arithmetic.

    The dot product is a higher-order function (JVM side).  Targets are
    ``y[horizon]`` when the samples carry ``y``.  A key's samples are dealt by
    runs of ``BUCKET_WINDOWS`` windows to at most ``SALTS`` tasks; its model is
    repeated as often as there are runs (``SALTS`` times where the number of
    ``windows`` is not known), once for short series.  A model is wider than a
    sample, so both sides are dealt before the join and only what is measured
    to be small is broadcast.
    """
    keys = list(keys)
    dot = F.aggregate(F.zip_with(F.col(f), F.col("coef"), lambda a, b: a * b), F.lit(0.0),
                      lambda acc, v: acc + v)
    pred = F.col("intercept") + dot
    has_y = "y" in samples.columns
    copies = SALTS if windows is None else max(1, min(SALTS, -(-windows // BUCKET_WINDOWS)))
    run = F.coalesce(F.pmod(F.floor(F.col(window) / F.lit(BUCKET_WINDOWS)), F.lit(copies)).cast("int"), F.lit(0))
    needed = [window, *carry, f, *(["y"] if has_y else [])]
    dealt = samples.select(*keys, *needed, run.alias("_run")).repartition(*keys, "_run")
    models = model.drop("fmean", "n").withColumn("_run", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).repartition(*keys, "_run")
    j = dealt.join(models, [*keys, "_run"])
    cols = [c for c in model.columns if c not in (*keys, "horizon", "intercept", "coef", "fmean", "n")]
    tgt = F.element_at(F.col("y"), F.col("horizon") + 1) if has_y else F.lit(None).cast("double")
    return j.select(*keys, *cols, window, *carry, "horizon",
                    (clip_floor(pred) if clip else pred).alias("prediction"), tgt.alias("target"))
