"""Distributed plans over whole tables: suppression, permutation, mappings, audits."""
