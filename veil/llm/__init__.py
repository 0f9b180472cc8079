"""Operators for training data: near duplicates, quality, toxicity, personal data, chats, tokens, repeats.

Nothing outside this package imports it; its queries are in ``queries``.
"""
