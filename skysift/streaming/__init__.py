"""Chunked processing of recordings, in batch and as a stream."""
