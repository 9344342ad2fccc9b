"""Structured Streaming: stateless scoring of request streams (ST1)."""

from roadflow.streaming.scoring import request_stream, run_available, score_stream  # noqa: F401
