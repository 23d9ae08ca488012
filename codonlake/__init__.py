"""Prokaryotic gene finding and its grading, written as Spark DataFrame jobs."""
