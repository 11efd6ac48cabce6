"""Text-reuse analytics and corpus preparation on Spark."""
