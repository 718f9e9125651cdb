"""Screen-activity analytics and training-data operators on Spark."""
