"""Structured Streaming twins of the monitoring and routing jobs (ST-1..3)."""

from fraudscope.streaming.jobs import (
    event_time,
    start_alerts,
    start_review_queue,
    start_window_partials,
    window_partials,
)

__all__ = ["event_time", "start_alerts", "start_review_queue", "start_window_partials", "window_partials"]
