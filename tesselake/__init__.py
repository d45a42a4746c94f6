"""A native PySpark engine for striped, mirrored file layouts, with operators for training data."""
