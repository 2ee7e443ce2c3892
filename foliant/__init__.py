"""foliant: source-traceable retrieval over laid-out documents, written for Spark."""
