"""tabiya: a Spark-native analytics engine for chess game databases and opening books."""
