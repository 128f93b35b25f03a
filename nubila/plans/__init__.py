"""Composed plans: registered queries with their SQL, and whole analyses."""
