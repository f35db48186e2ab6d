"""Structured Streaming versions of the intake and report jobs."""
