"""Spark jobs for earthquake and ground-deformation tables."""
