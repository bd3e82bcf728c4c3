"""The registered queries: every operator over whole test tables, with its SQL counterpart."""
