"""End-to-end searches, evaluation, and the registered queries with their SQL."""
