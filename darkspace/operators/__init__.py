"""Analyses over packets."""
