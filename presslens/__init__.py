"""Spark jobs on how news media report on the world."""
