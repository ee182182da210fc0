"""Named queries; importing this package registers them all."""

from marlstone.plans import cascade_queries, entity_queries, file_queries, graph_queries, page_queries, quality_queries, retrieval_queries, stream_queries  # noqa: F401
from marlstone.plans.registry import QUERIES, SQL  # noqa: F401
