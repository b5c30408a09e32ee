"""The stateless feature projections on a streaming DataFrame.

The reference is batch only; what carries over to a stream is that the
calendar flags, fixed-domain one-hots, scaler application and clipping are
row-local projections (the scaler is a stream-static join against the
training statistics), so new panel rows can be featurized as they arrive.
No watermark or state is needed and none is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourglass.functions.calendar import attribute_columns
from hourglass.functions.numeric import clip_floor, nan_to_null
from hourglass.operators.scale import apply_scaler


def featurize(stream: DataFrame, stats: DataFrame | None = None, ts: str = "ts") -> DataFrame:
    """Long panel rows ``(series, ts, value)`` -> + 45 calendar attributes (+ ``scaled``).

    Works the same on a batch or a streaming DataFrame; ``stats`` is a
    static ``(series, mean, std)`` table from training.
    """
    out = stream.select("series", F.col(ts).cast("timestamp").alias("ts"),
                        nan_to_null(F.col("value").cast("double")).alias("value"), *attribute_columns("ts"))
    if stats is not None:
        out = apply_scaler(out, stats)
    return out


def clip_predictions(stream: DataFrame, col: str = "prediction") -> DataFrame:
    return stream.withColumn(col, clip_floor(col))


def start_featurizer(stream: DataFrame, stats: DataFrame | None, path: str, checkpoint: str,
                     trigger_once: bool = True):
    """Write featurized rows as parquet with exactly-once file-sink semantics.

    ``checkpoint`` must be a shared folder (for instance under the
    session's ``spark.checkpoint.dir``).
    """
    w = (featurize(stream, stats).writeStream.format("parquet")
         .option("path", path).option("checkpointLocation", checkpoint).outputMode("append"))
    if trigger_once:
        w = w.trigger(availableNow=True)
    return w.start()
