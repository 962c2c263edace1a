"""Structured Streaming forms of the ad statistics."""
