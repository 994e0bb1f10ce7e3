"""Seasonal panel analytics as DataFrame operators."""
