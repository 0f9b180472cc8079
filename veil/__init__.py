"""Privacy policies for Spark tables and streams."""

from veil.errors import PolicyError
from veil.functions.registry import register_method
from veil.operators.materialize import temporary_tables
from veil.plans.anonymize import anonymize, preview
from veil.policy import ColumnRule, Policy, TablePolicy
from veil.settings import Settings

__all__ = [
    "ColumnRule", "Policy", "PolicyError", "Settings", "TablePolicy",
    "anonymize", "preview", "register_method", "temporary_tables",
]
