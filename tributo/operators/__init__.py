"""Set-oriented operators over the canonical tables: each takes DataFrames and returns one."""
