"""quarry: a PySpark-native analytics engine with a MySQL-dialect SQL surface."""
