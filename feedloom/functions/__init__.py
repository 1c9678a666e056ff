"""Functions of feedloom."""
