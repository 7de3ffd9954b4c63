"""Operators on tables: scans aside, everything that joins, groups, orders or spans rows."""
