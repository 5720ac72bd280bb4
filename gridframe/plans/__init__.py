"""End-to-end plans: fixtures from the driver tables, the query catalogue and
the batch jobs (convert, transpose, lookup / verify, multiply)."""
