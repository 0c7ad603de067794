"""Driver queries: every operator bound to the given tables, with its SQL counterpart."""
