"""DataFrame -> DataFrame operators, to be composed with `df.transform`."""
