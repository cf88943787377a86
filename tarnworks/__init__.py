"""Spark-native operators for record pipelines, changelogs, versioned state and sketches."""
