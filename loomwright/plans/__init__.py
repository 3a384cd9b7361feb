"""Queries over the driver's tables; importing the package registers them all."""
