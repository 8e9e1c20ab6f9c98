"""All registered queries (imported for their registration side effect)."""

from spoorgrid.plans import catalog_decisions, catalog_maps, catalog_points, catalog_retrieval, catalog_sequences, catalog_streams  # noqa: F401
from spoorgrid.plans.registry import REGISTRY  # noqa: F401
