"""Information-state analytics on Spark: packet logs to typed tables, visibility, beliefs and training-data clean-up."""
