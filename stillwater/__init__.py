"""Cleaning and scoring of irregular water-level series as Spark jobs."""
