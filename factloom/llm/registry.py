"""What this subpackage registers with the driver."""

from factloom.llm.oracles import ORACLES
from factloom.llm.queries import QUERIES

__all__ = ["ORACLES", "QUERIES"]
