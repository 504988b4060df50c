"""DataFrame operators: packed fields, raw lines, snapshots, tree aggregation, lookups, search, order."""
