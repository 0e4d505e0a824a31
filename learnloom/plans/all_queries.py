"""Imports every query module so that the registry is complete."""

from learnloom.plans import bank_queries, extract_queries, log_queries, mission_queries, quality_queries, replay_queries, skill_queries, stream_queries  # noqa: F401
from learnloom.plans import block_queries  # noqa: F401  (reads the ones above)
from learnloom.plans.registry import ORACLE, PLANS, QUERIES  # noqa: F401
