"""Plumbline: dataset validation and collapse detection as Spark jobs."""
