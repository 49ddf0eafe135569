from roadstats.streaming.ingest import ingest_report, ingest_stream, stored_lines, stream_raw, take_in

__all__ = ["ingest_report", "ingest_stream", "stored_lines", "stream_raw", "take_in"]
