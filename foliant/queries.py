"""All named queries of the library, and the SQL of those that have one."""

from . import catalogue, catalogue_more

QUERIES, ORACLES = catalogue.QUERIES, catalogue.ORACLES
__all__ = ["ORACLES", "QUERIES", "catalogue", "catalogue_more"]
