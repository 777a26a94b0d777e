"""rillspark: a PySpark-native analytics engine for daily flow records, river networks and basin attributes."""
