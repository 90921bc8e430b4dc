"""Structured Streaming entry points (scoring and upload merge)."""

from hourcast.streaming.jobs import read_text_stream, score_stream, scored_stream, upload_stream

__all__ = ["read_text_stream", "score_stream", "scored_stream", "upload_stream"]
