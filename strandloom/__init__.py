"""Spark-native analytics for long-form omics tables: intervals, matrices, graphs, embeddings."""
