"""Registered queries and the SQL that checks them, by area."""

from workload import demographic, outcome, preparation, profiling, representation, testing, visual

AREAS = (representation, outcome, testing, profiling, preparation, demographic, visual)
