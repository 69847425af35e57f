"""Streams of sections."""
