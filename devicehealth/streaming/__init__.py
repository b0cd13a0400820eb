"""Streams over arriving telemetry files, messages and opt-outs."""
