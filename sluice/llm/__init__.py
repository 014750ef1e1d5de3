"""Operators for preparing training data. Nothing else in sluice imports this."""
