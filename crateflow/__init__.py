"""Spark-first analytics for music-library data: search, snapshots, feature resolution, rules and job pipelines."""
