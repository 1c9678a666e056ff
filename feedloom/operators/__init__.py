"""Operators of feedloom."""
