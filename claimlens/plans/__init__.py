"""End-to-end queries and their SQL counterparts."""
