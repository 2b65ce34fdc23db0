"""Named queries (operator + fixture parameters) and their SQL equivalents."""

from campaignlab.plans.registry import REGISTRY, QuerySpec  # noqa: F401


def load_all():
    """Import every query module so the registry is complete."""
    from campaignlab.plans import activity_queries, audience_queries, campaign_queries, status_queries  # noqa: F401

    return REGISTRY
