"""A Spark-native analytics engine for learning corpora and learner event logs."""
