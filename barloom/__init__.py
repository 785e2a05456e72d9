"""Barloom: daily-bar analytics and corpus preparation as Spark plans."""
