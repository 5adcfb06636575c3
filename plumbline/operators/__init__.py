"""Metrics, checks, profiles, suggestions and anomaly detection."""
