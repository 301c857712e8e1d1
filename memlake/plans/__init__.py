"""Queries over the operators, by family; importing this package registers them."""

from memlake.plans import core, facts, lifecycle, more, routing, rules, search, streams  # noqa: F401
