"""termloom: Spark-native text retrieval, learning-to-rank and corpus preparation."""
