"""Column-level building blocks: text, lookups, JSON bodies, captured HTML."""
