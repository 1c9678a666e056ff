"""Plans of feedloom."""
