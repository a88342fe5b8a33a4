"""Formulas over panel fields: checked, then run as DataFrame stages."""
