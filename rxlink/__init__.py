"""A PySpark engine that turns noisy document text into linked, structured records."""
