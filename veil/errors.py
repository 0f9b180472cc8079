"""Errors raised while a policy is checked, before any job starts."""


class PolicyError(ValueError):
    """A policy names something that cannot be applied safely."""
