"""The registered queries, the tables they stand on, and their SQL counterparts."""
