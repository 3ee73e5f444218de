"""provenlake: a PySpark engine that checks numeric claims in reports against the sources they cite."""
