"""palisade: security-log analytics written as Spark jobs."""
