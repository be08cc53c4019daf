"""Queries over the driver's tables, and the same in SQL; ``MODULES`` lists them all."""

from tessera.plans import algebra_queries, boolean_queries, queries, section_queries, smooth_queries, solid_queries

MODULES = (queries, solid_queries, algebra_queries, section_queries, boolean_queries, smooth_queries)
