"""Structured Streaming: the pipeline per micro-batch (ST1-ST5)."""
