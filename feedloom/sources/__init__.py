"""Sources of feedloom."""
