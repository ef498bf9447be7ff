"""Column expressions: no DataFrame, no job, all inside generated code."""
