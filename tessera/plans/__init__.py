"""Registered queries, a module for each family, each beside the SQL that answers it."""
