"""PySpark-native analytics for bibliographic and document catalogues."""
