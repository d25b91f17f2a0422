"""The ordered operators over unbounded input."""
