"""Registered queries."""

from . import flow, holdings, market, options, registry, risk, streams

__all__ = ["flow", "holdings", "market", "options", "registry", "risk", "streams"]
