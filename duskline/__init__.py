"""Rare-event risk analysis over entity-by-month panels, as Spark DataFrames."""
