"""Queries that apply the operators to tables."""

from graphlens.plans import calculus, commerce, ml, networks, programs, sequences, shapes, texts  # noqa: F401
from graphlens.plans.registry import QUERIES, SQL  # noqa: F401
