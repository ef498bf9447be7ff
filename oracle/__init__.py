"""DuckDB SQL that computes every registered query independently of the Spark code."""
