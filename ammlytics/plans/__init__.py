"""Registered queries; importing the modules fills the registry."""

from ammlytics.plans import amm, chain, controls, evaluation, liquidity, market, portfolios, providers, records, research, studies
from ammlytics.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "amm", "chain", "controls", "evaluation", "liquidity", "market", "portfolios", "providers", "records", "research", "studies"]
