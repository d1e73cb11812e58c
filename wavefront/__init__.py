"""Graph traversal over edge tables with Spark."""
