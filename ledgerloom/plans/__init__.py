"""Ready-made queries over the supplied tables, and their SQL equivalents."""
