"""Stateless feature projections applied to streaming DataFrames."""

from hourglass.streaming.features import clip_predictions, featurize, start_featurizer  # noqa: F401
