"""Connected components, as the operators of this subpackage use them."""

from hearthgraph.operators.graph import components

__all__ = ["components"]
