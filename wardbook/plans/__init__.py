"""Registered queries over the driver test data, and their SQL oracles."""
