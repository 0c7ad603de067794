"""Hourly sensor panels, two-clock forecast panels and forecast evaluation on Spark."""
