"""DuckDB SQL for every query, written against the stored tables, without nested columns."""
