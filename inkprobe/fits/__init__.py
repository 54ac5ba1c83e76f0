"""Many fits at once: folds, columns and settings are runs, and all runs of a classifier share their Spark jobs."""
