"""A PySpark-native analytics engine for conversational and training text."""
