"""Registered queries: every operator wired to the driver's tables."""
