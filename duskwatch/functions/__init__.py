"""Column builders: field access, predicates, ip and text helpers."""
