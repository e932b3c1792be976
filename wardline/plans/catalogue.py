"""All registered queries."""

from wardline.plans import queries_base, queries_models, queries_ops, queries_risk, queries_streams  # noqa: F401
from wardline.plans.registry import ORACLES, QUERIES  # noqa: F401
