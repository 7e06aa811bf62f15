"""Chunk-wise annotation as a stream."""
