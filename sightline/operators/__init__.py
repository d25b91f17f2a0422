"""DataFrame operators: tables and settings in, a table out, no action inside."""
