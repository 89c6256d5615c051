"""A PySpark-native engine for curating labelled corpora and evaluating binary scorers."""
