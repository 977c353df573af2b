"""Queries of the reference's operators over the driver's tables."""
