"""Policies on streams, and k-anonymity within event-time windows and sessions."""

from veil.streaming.windows import session_k_anonymity, shuffle_batches, windowed_k_anonymity

__all__ = ["session_k_anonymity", "shuffle_batches", "windowed_k_anonymity"]
