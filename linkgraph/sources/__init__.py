"""Sources and sinks: fixture views over the test tables, the reference's
native text layouts (adjacency lists, demography TSV, ranked lists, 2-hop
tuples, hidden edges) and parquet tables."""
