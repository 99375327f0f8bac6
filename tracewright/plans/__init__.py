"""The registered queries: the engine's operators on the given tables, and their SQL."""
