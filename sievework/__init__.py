"""A PySpark-native engine that turns captured web pages and crawl logs into a clean, queryable catalogue."""
