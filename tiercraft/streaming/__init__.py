"""Structured Streaming: segment record files as they arrive."""

from tiercraft.streaming.batches import segment_stream

__all__ = ["segment_stream"]
