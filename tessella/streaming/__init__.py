"""Bars over streams."""
