"""PySpark-native engine for evaluating and calibrating monocular distance estimates."""
