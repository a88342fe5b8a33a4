"""Operators over panels: time-series (ts), cross-sectional (cs), metrics, portfolios, research, submission, library, combination."""
