"""Nothing here: the field has no unbounded source (see README)."""
