"""The fixed plan over one table, and the catalogue of queries with their SQL."""
