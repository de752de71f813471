"""tessera: Spark-native analytics for labelled corpora, embeddings and event sequences."""
