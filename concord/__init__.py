"""concord: a Spark-native entity-resolution and master-data-quality engine."""
