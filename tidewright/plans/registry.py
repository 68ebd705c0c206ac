"""Importing this module registers every query."""

from tidewright.plans import q_erasure, q_fitted, q_inventory, q_joins, q_ledger, q_metrics, q_more, q_panel, q_profile, q_text  # noqa: F401
