"""All named queries of the engine and their SQL."""

from sgspark.plans.models import QUERIES
from sgspark.plans.models_oracle import ORACLE_SQL as MODELS
from sgspark.plans.oracle import ORACLE_SQL as FIRST

ORACLE_SQL = FIRST | MODELS

__all__ = ["ORACLE_SQL", "QUERIES"]
