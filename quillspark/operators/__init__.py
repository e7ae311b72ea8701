"""Estimators and aggregates."""
