"""The same cleaning on revision files as they arrive."""

from topicatlas.streaming.ingest import stream_edits

__all__ = ["stream_edits"]
