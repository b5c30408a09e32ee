"""Ridge on inputs wider than the number of windows, solved window by window.

With ``n`` windows and ``p`` inputs per key, the usual normal equations are
``p x p``; the dual ones are ``n x n``, which is far less when a window has
thousands of inputs (48 hours x 46 values).  For centred inputs ``X`` and
penalties ``l2_f`` per family of inputs::

    K = sum_f X_f X_f' / l2_f,   (K + I) a = Y - mean(Y),   w_f = X_f' a / l2_f

1. Samples are packed into blocks of ``WINDOWS`` windows (one group each).
2. Tiles of ``K`` are made per pair of blocks and family; a group holds two blocks.
3. One eigendecomposition per key and ratio of the penalties gives ``a`` for
   every config of a grid, and the leave-one-window-out errors: the residual
   is ``a`` itself, and its leverage follows from the eigenvectors.
4. Every block returns its share ``X_f' a``; the shares are added up by
   built-in sums in chunks.

Scale: this form is used for keys with at most ``p`` windows, so a key has at
most ``p / WINDOWS`` blocks and its matrix is bounded by the model's width.
Keys with more windows take the usual normal equations (``direct``), which
are exact too and sum a fixed-size vector however many windows there are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourglass.operators.joins import grid_rows
from hourglass.plans import direct
from hourglass.session import materialize

WINDOWS = 128  # windows of a block


def _fields(df: DataFrame, cols: Sequence[str]) -> list[T.StructField]:
    return [T.StructField(c, df.schema[c].dataType) for c in cols]


def _key(values) -> tuple:
    return values if isinstance(values, tuple) else (values,)


def pack_blocks(samples: DataFrame, keys: Sequence[str], window: str = "window_id") -> DataFrame:
    """``(keys, block, n, x, y)``: the finite samples of up to ``WINDOWS`` windows as row-major float64 matrices."""
    keys = list(keys)
    schema = T.StructType([*_fields(samples, keys), T.StructField("block", T.LongType()), T.StructField("n", T.LongType()),
                           T.StructField("x", T.BinaryType()), T.StructField("y", T.BinaryType())])

    def pack(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_window")
        x, y = np.stack(pdf["f"].to_numpy()).astype(np.float64), np.stack(pdf["y"].to_numpy()).astype(np.float64)
        ok = np.isfinite(x).all(axis=1) & np.isfinite(y).all(axis=1)
        return pd.DataFrame([(*key, int(ok.sum()), x[ok].tobytes(), y[ok].tobytes())], columns=schema.names)

    block = F.floor(F.col(window) / F.lit(WINDOWS)).cast("long").alias("block")
    return (samples.select(*keys, block, F.col(window).alias("_window"), "f", "y")
            .groupBy(*keys, "block").applyInPandas(pack, schema).where("n > 0"))


def _matrix(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, np.float64).reshape(n, -1)


def kernel_tiles(blocks: DataFrame, keys: Sequence[str], families: Sequence[int]) -> DataFrame:
    """``(keys, low, high, tiles)`` for every pair of blocks of a key: inner products of their windows, one matrix per family."""
    keys, cuts = list(keys), np.cumsum(families)[:-1]
    schema = T.StructType([*_fields(blocks, keys), T.StructField("low", T.LongType()), T.StructField("high", T.LongType()),
                           T.StructField("tiles", T.ArrayType(T.BinaryType()))])

    def tile(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        a, b = pdf.iloc[0], pdf.iloc[-1]
        xa, xb = _matrix(a["x"], a["n"]), _matrix(b["x"], b["n"])
        tiles = [(fa @ fb.T).tobytes() for fa, fb in zip(np.split(xa, cuts, axis=1), np.split(xb, cuts, axis=1), strict=True)]
        return pd.DataFrame([(*key, tiles)], columns=schema.names)

    partners = blocks.groupBy(*keys).agg(F.collect_set("block").alias("partners"))
    pairs = (blocks.join(partners, keys).select(*keys, "block", "n", "x", F.explode("partners").alias("other"))
             .withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).drop("other"))
    return pairs.groupBy(*keys, "low", "high").applyInPandas(tile, schema)


def solve_dual(kernels: list[np.ndarray], y: np.ndarray, penalties: Sequence[Sequence[float]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For every config ``(a, leave-one-out residuals)``, one eigendecomposition per ratio of the penalties.

    ``kernels`` are the families' inner products of the raw inputs;
    centring them centres the inputs.
    """
    n = len(y)
    centred = [k - k.mean(axis=0) - k.mean(axis=1, keepdims=True) + k.mean() for k in kernels]
    target = y - y.mean(axis=0)
    known: dict[tuple, tuple] = {}
    for config in penalties:
        first = float(config[0])
        ratio = tuple(first / float(c) for c in config)
        if ratio not in known:
            s, u = np.linalg.eigh(sum(r * k for r, k in zip(ratio, centred, strict=True)))
            known[ratio] = (np.maximum(s, 0.0), u, u.T @ target)
        s, u, turned = known[ratio]
        shrunk = 1.0 / (1.0 + s / first)
        a = u @ (shrunk[:, None] * turned)
        free = np.maximum((u * u) @ shrunk - 1.0 / n, 1e-300)
        yield a, a / free[:, None] if n > 1 else np.full_like(a, np.nan)


def _solutions(blocks: DataFrame, tiles: DataFrame, keys: Sequence[str], configs: list[dict], param_cols: Sequence[str]) -> DataFrame:
    """``(keys, block, config, a, loo)`` per block of a key: dual weights and the squared leave-one-out errors of its windows, summed per horizon."""
    keys = list(keys)
    schema = T.StructType([*_fields(blocks, keys), T.StructField("block", T.LongType()), T.StructField("config", T.IntegerType()),
                           T.StructField("a", T.BinaryType()), T.StructField("loo", T.ArrayType(T.DoubleType()))])
    penalties = [[float(c[p]) for p in param_cols] for c in configs]

    def solve(key, parts: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        parts = parts.sort_values("block")
        ends = np.cumsum(parts["n"].to_numpy())
        at = {b: slice(int(e - n), int(e)) for b, n, e in zip(parts["block"], parts["n"], ends, strict=True)}
        y = np.concatenate([_matrix(d, n) for d, n in zip(parts["y"], parts["n"], strict=True)])
        kernels = [np.zeros((len(y), len(y))) for _ in param_cols]
        for low, high, tiles in zip(pairs["low"], pairs["high"], pairs["tiles"], strict=True):
            rows, cols = at[low], at[high]
            for k, data in zip(kernels, tiles, strict=True):
                k[rows, cols] = _matrix(data, rows.stop - rows.start)
                k[cols, rows] = k[rows, cols].T
        out = []
        for c, (a, loo) in enumerate(solve_dual(kernels, y, penalties)):
            out += [(*key, b, c, a[s].tobytes(), (loo[s] ** 2).sum(axis=0).tolist()) for b, s in at.items()]
        return pd.DataFrame(out, columns=schema.names)

    light = blocks.select(*keys, "block", "n", "y")
    return light.groupBy(*keys).cogroup(tiles.groupBy(*keys)).applyInPandas(solve, schema)


def _shares(blocks: DataFrame, solutions: DataFrame, keys: Sequence[str], p: int, q: int) -> DataFrame:
    """Chunks ``(keys, config, chunk, v0..)`` of ``[n, sum f, sum y, X'a]`` of every block."""
    keys = list(keys)
    width = 1 + p + q + p * q
    n_chunks = -(-width // direct.CHUNK)
    schema = T.StructType([*_fields(blocks, keys), T.StructField("config", T.IntegerType()), T.StructField("chunk", T.IntegerType()),
                           *[T.StructField(f"v{j}", T.DoubleType()) for j in range(direct.CHUNK)]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for rec in pdf.to_dict("records"):
                x, y, a = (_matrix(rec[c], rec["n"]) for c in ("x", "y", "a"))
                vector = np.zeros(n_chunks * direct.CHUNK)
                vector[:width] = np.concatenate([[len(x)], x.sum(axis=0), y.sum(axis=0), (x.T @ a).ravel()])
                yield direct._frame([*keys, "config"], [(*[rec[k] for k in keys], rec["config"])], [vector], n_chunks)

    return blocks.join(solutions.select(*keys, "block", "config", "a"), [*keys, "block"]).mapInPandas(run, schema)


def fit_kernel(samples: DataFrame, keys: Sequence[str], p: int, q: int, families: Sequence[int], param_cols: Sequence[str],
               configs: list[dict], window: str = "window_id") -> tuple[DataFrame, DataFrame]:
    """``(models, loo)`` by the dual form.

    ``models`` is shaped as ``direct.solve``'s; ``loo`` has the mean squared
    leave-one-window-out error per key and config over all horizons (null for
    a single window).  Penalties must be positive.
    """
    keys, names = list(keys), list(configs[0])
    if min(float(c[p_]) for c in configs for p_ in param_cols) <= 0:
        raise ValueError("the dual form needs positive penalties")
    blocks = materialize(pack_blocks(samples, keys, window), "kernel-blocks")
    solutions = materialize(_solutions(blocks, kernel_tiles(blocks, keys, families), keys, configs, param_cols), "kernel-solutions")
    summed = direct.summed_stats(_shares(blocks, solutions, keys, p, q), [*keys, "config"])
    which = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in c.items()]) for c in configs])
    kinds = T.StructType([T.StructField(n, which_type(configs, n)) for n in names])
    model = T.StructType([*_fields(samples, keys), *kinds.fields, T.StructField("horizon", T.IntegerType()), T.StructField("intercept", T.DoubleType()),
                          T.StructField("coef", T.ArrayType(T.DoubleType())), T.StructField("fmean", T.ArrayType(T.DoubleType())), T.StructField("n", T.LongType())])

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for rec in pdf.to_dict("records"):
                v = np.asarray(rec["stats"], np.float64)
                n, config = v[0], configs[rec["config"]]
                fmean, ymean = v[1:1 + p] / n, v[1 + p:1 + p + q] / n
                scale = np.concatenate([np.full(size, 1.0 / float(config[c])) for size, c in zip(families, param_cols, strict=True)])
                coef = v[1 + p + q:1 + p + q + p * q].reshape(p, q) * scale[:, None]
                intercept = ymean - fmean @ coef
                for h in range(q):
                    rows.append((*[rec[k] for k in keys], *config.values(), h, float(intercept[h]), coef[:, h].tolist(), fmean.tolist(), int(n)))
            if rows:
                yield pd.DataFrame(rows, columns=model.names)

    models = summed.mapInPandas(finish, model)
    sizes = blocks.groupBy(*keys).agg(F.sum("n").alias("n"))
    per_key = solutions.groupBy(*keys, "config").agg(F.sum(F.aggregate("loo", F.lit(0.0), lambda s, v: s + v)).alias("loo"))
    loo = (per_key.join(sizes, keys).withColumn("_c", F.get(which, F.col("config")))
           .select(*keys, *[F.col(f"_c.{c}").alias(c) for c in names], F.nanvl(F.col("loo") / (F.col("n") * q), F.lit(None).cast("double")).alias("loo_mse"), "n"))
    return models, loo


def which_type(configs: list[dict], name: str) -> T.DataType:
    """The Spark type of a config value."""
    value = configs[0][name]
    return T.StringType() if isinstance(value, str) else T.DoubleType() if isinstance(value, float) else T.LongType()


def fit_wide(samples: DataFrame, keys: Sequence[str], p: int, q: int, families: Sequence[int] | None = None, param_cols: Sequence[str] = ("l2",),
             grid: DataFrame | list[dict] | None = None, l2: float = 1.0, window: str = "window_id") -> DataFrame:
    """Ridge models of ``direct.fit_direct``'s shape for wide inputs: dual where a key has at most ``p`` windows, else primal."""
    keys, families = list(keys), list(families or [p])
    configs = grid_rows(grid) if grid is not None else [{c: float(l2) for c in param_cols}]
    samples = materialize(samples.select(*keys, window, "f", "y"), "wide-samples")
    counts = materialize(samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), "wide-counts")
    many = counts.where(F.col("_n") > p).select(*keys)
    if many.isEmpty():
        return fit_kernel(samples, keys, p, q, families, param_cols, configs, window)[0]
    few = fit_kernel(samples.join(many, keys, "left_anti"), keys, p, q, families, param_cols, configs, window)[0]
    rest = direct.fit_direct(samples.join(many, keys, "left_semi"), keys, p, q, grid=configs, families=families, param_cols=param_cols, window=window)
    return few.unionByName(rest.select(few.columns))
