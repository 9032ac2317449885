"""msgsieve: Spark-native operators for labelled message corpora."""
