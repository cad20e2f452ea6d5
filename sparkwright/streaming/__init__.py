"""Streaming: apply fitted preparation stages to a stream."""
