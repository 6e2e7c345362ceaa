"""Windows over time, for tables and streams alike."""

from lakescan.streaming.windows import ranged, run_available, session, stream_from, stream_of, watermarked

__all__ = ["ranged", "run_available", "session", "stream_from", "stream_of", "watermarked"]
