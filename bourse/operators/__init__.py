"""Operators on bars, orders, portfolios and surfaces."""
