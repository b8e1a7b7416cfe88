"""The stateless operators on streams, and incremental counts and dedup."""
