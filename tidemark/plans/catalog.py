"""All queries over the reference's own operators."""

from tidemark.plans import q_evaluate, q_factor, q_listings, q_panel, q_relational, q_sim, q_sources, q_stats, q_text  # noqa: F401
from tidemark.plans.registry import ORACLES, QUERIES  # noqa: F401
