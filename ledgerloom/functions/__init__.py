"""Column builders: scalar functions applied to whole tables."""
