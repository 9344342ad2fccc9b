"""Scans (observation tables, request records) and sinks."""

from roadflow.sources.observations import (  # noqa: F401
    load_table, obs_events, obs_orders, read_observations, to_observations,
)
from roadflow.sources.requests import decode_requests, requests_from_events  # noqa: F401
from roadflow.sources.sinks import (  # noqa: F401
    leaderboard_frame, load_model, save_model, to_json_records, write_csv,
    write_run_config,
)
