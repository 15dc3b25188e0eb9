"""Column builders: draws, strategies, vocabularies, coercion."""
