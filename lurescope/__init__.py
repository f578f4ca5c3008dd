"""URL-risk analytics as Spark jobs: features, drift, preparation, models, logs."""
