"""Query catalogue: each module binds operators to the tables of a data directory."""
