"""rowsieve: check, repair, enrich and split tables on Spark.

Every operator takes DataFrames and returns DataFrames; nothing is computed
until a sink or an action asks for it.
"""

from rowsieve.config import RunConfig
from rowsieve.operators.rules import RuleSet, expense_rules

__all__ = ["RunConfig", "RuleSet", "expense_rules"]
