"""All registered queries."""

from lakestate.plans import capsule_queries, feed_queries, policy_queries, record_queries, retrieval_queries, state_queries  # noqa: F401
from lakestate.plans.registry import ORACLES, QUERIES  # noqa: F401
