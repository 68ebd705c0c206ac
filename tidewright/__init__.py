"""tidewright: a Spark-first engine for text corpora, labels and event panels."""
