"""Sampling, labelling, folds, fits and evaluation over DataFrames of weighted points."""
