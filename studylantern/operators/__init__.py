"""DataFrame operators: merge, checks, signals, flags, drafts, review lifecycle."""
