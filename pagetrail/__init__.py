"""Page, trajectory and evaluation analytics as DataFrame -> DataFrame functions on Spark."""
