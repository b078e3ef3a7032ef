"""PySpark-native analytics for evidence-grounded question answering runs."""
