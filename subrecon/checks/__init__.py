"""Independent DuckDB SQL for the correctness gate."""
