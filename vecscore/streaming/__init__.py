"""Streaming: incremental embedding as files arrive."""
