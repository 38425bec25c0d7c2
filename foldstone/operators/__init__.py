"""Relational operators: joins, profiles, ranks, folds, encodings, metrics, calibration."""
