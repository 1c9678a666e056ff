"""Streaming of feedloom."""
