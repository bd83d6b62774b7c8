"""Customer-lapse analytics as Spark jobs: quality, features, models, evaluation, monitoring."""
