"""Queries: operators bound to tables, registered by name with the SQL that checks them."""
