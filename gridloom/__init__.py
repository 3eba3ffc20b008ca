"""Gridloom: spatial-planning analytics and corpus operators as Spark DataFrame jobs."""
