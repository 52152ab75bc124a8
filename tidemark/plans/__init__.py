"""Stages chained into the end-to-end jobs."""
