"""Input views over the provided tables, the query registry and its SQL counterparts."""
