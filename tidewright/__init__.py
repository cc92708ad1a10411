"""PySpark-native generation, profiling, validation and governed querying of relational data."""
