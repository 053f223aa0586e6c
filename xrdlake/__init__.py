"""Diffraction and sample analytics as DataFrame -> DataFrame operators on Spark."""

__version__ = "0.1.0"
