"""Column expressions: value semantics, predicates, modifiers, routing hashes."""
