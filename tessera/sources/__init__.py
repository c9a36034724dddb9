"""Sources and sinks of series tables (id BIGINT, series ARRAY<FLOAT>)."""
