"""All registered queries of the engine: importing the modules that hold them fills the registry."""

from prismfold.plans import ingest_queries, matching, pages, stored, taxonomy_queries
from prismfold.plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "ingest_queries", "matching", "pages", "stored", "taxonomy_queries"]
