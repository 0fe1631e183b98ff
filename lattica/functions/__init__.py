"""Data types and operators: pure functions from columns to columns."""
