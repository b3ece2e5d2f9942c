from loctrack.streaming.jobs import (  # noqa: F401
    batch_grid_stream, channel_sessions_stream, fan_out_stream, fan_out_streams, group_within_stream, ingest_stream,
    latest_state_stream, lifetimes_stream, newest_n_stream, publish_rate_stream, stream_checkpoint,
)
