"""Every registered query, gathered from the query modules."""

from tallyweave.plans import (  # noqa: F401
    audit_queries,
    catalog_queries,
    stock_queries,
    stream_queries,
    view_queries,
    extract_queries,
    insight_queries,
    price_queries,
    reply_queries,
    search_queries,
)
from tallyweave.plans.registry import REGISTRY  # noqa: F401
