"""Ridge with a penalty per family by conjugate gradients, without any matrix per key.

Unknowns are ``u = sqrt(penalty) * w``, so the system is ``I + D X'X D`` with
``D = 1 / sqrt(penalty)`` and centred ``X``; all horizons and keys go on in
step.  A step is one pass over the blocks of samples: each block multiplies
the direction of its key and returns ``X'(X d)``; the shares are added up by
built-in sums in chunks, and the next state (solution, residual, direction) is
written as parquet in the shared folder.  The driver reads the largest
relative residual, one number.  The steps end by tolerance, and at the latest
after three times as many steps as there are inputs.

Scale: a task holds one block and one vector per key; a hot key's blocks are
dealt over tasks, and its direction goes to them by a salted join.  An
executor that is lost costs one step.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourglass.operators.joins import per_key_join
from hourglass.plans import direct
from hourglass.plans.kernel import _fields, _matrix, pack_blocks
from hourglass.session import materialize, release

VECTORS = ("u", "r", "d")


def _chunk_schema(df: DataFrame, keys: Sequence[str]) -> T.StructType:
    return T.StructType([*_fields(df, keys), T.StructField("chunk", T.IntegerType()), *[T.StructField(f"v{j}", T.DoubleType()) for j in range(direct.CHUNK)]])


def _summed(blocks: DataFrame, keys: Sequence[str], width: int, share) -> DataFrame:
    """Per key the sum over its blocks of ``share(record)``, a vector of ``width`` values."""
    n_chunks = -(-width // direct.CHUNK)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, total = None, None
        for pdf in batches:
            for rec in pdf.to_dict("records"):
                here = tuple(rec[k] for k in keys)
                if here != key:
                    if key is not None:
                        yield direct._frame(keys, [key], [total], n_chunks)
                    key, total = here, np.zeros(n_chunks * direct.CHUNK)
                total[:width] += share(rec)
        if key is not None:
            yield direct._frame(keys, [key], [total], n_chunks)

    return direct.summed_stats(blocks.sortWithinPartitions(*keys).mapInPandas(run, _chunk_schema(blocks, keys)), keys)


def fit_conjugate(samples: DataFrame, keys: Sequence[str], p: int, q: int, families: Sequence[int], penalties: Sequence[float],
                  window: str = "window_id", tolerance: float = 1e-10, max_steps: int | None = None) -> DataFrame:
    """Ridge models ``(keys, horizon, intercept, coef, fmean, n)`` of samples with arrays ``f`` (``p``) and ``y`` (``q``).

    ``families`` are the sizes of consecutive blocks of inputs, ``penalties``
    (positive) their penalties.  Ends when every key's residual is below
    ``tolerance`` times its right side.  No samples give no models.
    """
    keys = list(keys)
    if min(penalties) <= 0:
        raise ValueError("penalties must be positive")
    scale = np.concatenate([np.full(size, float(c) ** -0.5) for size, c in zip(families, penalties, strict=True)])
    blocks = materialize(pack_blocks(samples, keys, window), "cg-blocks")
    field = [T.StructField("n", T.DoubleType()), *[T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("fmean", "ymean", *VECTORS)], T.StructField("rest", T.DoubleType())]
    state_schema = T.StructType([*_fields(blocks, keys), *field])

    def begin(rec: dict) -> np.ndarray:
        x, y = _matrix(rec["x"], rec["n"]), _matrix(rec["y"], rec["n"])
        return np.concatenate([[len(x)], x.sum(axis=0), y.sum(axis=0), (x.T @ y).ravel()])

    def start(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for rec in pdf.to_dict("records"):
                v = np.asarray(rec["stats"], np.float64)
                n = v[0]
                fmean, ymean = v[1:1 + p] / n, v[1 + p:1 + p + q] / n
                b = scale[:, None] * (v[1 + p + q:1 + p + q + p * q].reshape(p, q) - n * np.outer(fmean, ymean))
                rows.append((*[rec[k] for k in keys], n, fmean.tolist(), ymean.tolist(), [0.0] * (p * q), b.ravel().tolist(), b.ravel().tolist(), 1.0 if b.any() else 0.0))
            yield pd.DataFrame(rows, columns=state_schema.names)

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for rec in pdf.to_dict("records"):
                u, r, d = (np.asarray(rec[c], np.float64).reshape(p, q) for c in VECTORS)
                n, fmean = rec["n"], np.asarray(rec["fmean"], np.float64)
                moved = np.asarray(rec["stats"], np.float64)[:p * q].reshape(p, q)
                ad = d + scale[:, None] * (moved - n * np.outer(fmean, fmean @ (scale[:, None] * d)))
                old, along = (r * r).sum(axis=0), (d * ad).sum(axis=0)
                size = np.divide(old, along, out=np.zeros(q), where=along > 0)
                u, r = u + size * d, r - size * ad
                new = (r * r).sum(axis=0)
                d = r + np.divide(new, old, out=np.zeros(q), where=old > 0) * d
                # The right side is what is left of it plus what the solution explains.
                side = ((u * u).sum(axis=0) + new) ** 0.5
                rest = float(np.max(np.divide(new ** 0.5, side, out=np.zeros(q), where=side > 0)))
                rows.append((*[rec[k] for k in keys], n, rec["fmean"], rec["ymean"], *[v.ravel().tolist() for v in (u, r, d)], rest))
            yield pd.DataFrame(rows, columns=state_schema.names)

    def along(rec: dict) -> np.ndarray:
        x = _matrix(rec["x"], rec["n"])
        return (x.T @ (x @ (scale[:, None] * np.asarray(rec["d"], np.float64).reshape(p, q)))).ravel()

    state = materialize(_summed(blocks, keys, 1 + p + q + p * q, begin).mapInPandas(start, state_schema), "cg-state")
    for _ in range(max_steps or 3 * p):
        worst = state.agg(F.max("rest")).first()[0]
        if worst is None or worst <= tolerance:
            break
        # Keys that are done stay in the state but are not multiplied again.
        open_ = state.where(F.col("rest") > tolerance)
        shares = _summed(per_key_join(blocks, open_.select(*keys, "d"), keys, "inner"), keys, p * q, along)
        moved = open_.join(shares, keys).mapInPandas(step, state_schema)
        nxt = materialize(moved.unionByName(state.where(F.col("rest") <= tolerance)), "cg-state")
        release(state)
        state = nxt
    model = T.StructType([*_fields(blocks, keys), T.StructField("horizon", T.IntegerType()), T.StructField("intercept", T.DoubleType()),
                          T.StructField("coef", T.ArrayType(T.DoubleType())), T.StructField("fmean", T.ArrayType(T.DoubleType())), T.StructField("n", T.LongType())])

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for rec in pdf.to_dict("records"):
                coef = np.asarray(rec["u"], np.float64).reshape(p, q) * scale[:, None]
                fmean = np.asarray(rec["fmean"], np.float64)
                intercept = np.asarray(rec["ymean"], np.float64) - fmean @ coef
                rows += [(*[rec[k] for k in keys], h, float(intercept[h]), coef[:, h].tolist(), fmean.tolist(), int(rec["n"])) for h in range(q)]
            if rows:
                yield pd.DataFrame(rows, columns=model.names)

    return state.mapInPandas(finish, model)
