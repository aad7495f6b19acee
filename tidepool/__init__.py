"""tidepool: a Spark-native engine that turns raw web pages into a queryable Markdown corpus."""
