"""Named queries over the driver's tables, each with its equivalent in DuckDB SQL."""
