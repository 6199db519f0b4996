"""expodex: a PySpark-native engine for crawled pages, exhibitor listings and text corpora."""
