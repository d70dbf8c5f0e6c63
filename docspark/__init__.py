"""docspark: a PySpark-native engine for collections of layered scanned documents."""
