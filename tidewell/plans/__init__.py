"""Runnable queries: every operator over the supplied tables, with SQL that gives the same rows."""
