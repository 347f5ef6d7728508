"""Structured Streaming jobs; each writes through an idempotent upsert or a checkpointed sink."""
