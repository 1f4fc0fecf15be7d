"""A PySpark-native engine for image corpora, block-transform coding and training-data pipelines."""
