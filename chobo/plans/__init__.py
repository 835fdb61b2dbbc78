"""Registered queries: the audit domain over the warehouse tables, with DuckDB equivalents."""
