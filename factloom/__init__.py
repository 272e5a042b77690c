"""factloom: a PySpark-native engine for typed fact graphs of source repositories."""
