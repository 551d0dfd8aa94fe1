"""lodesift: a PySpark-native engine for audit analytics and training-data preparation."""
