"""Writers: upsert, link appends, counters, dumps, versioned, clustered and bucketed tables (K1-K7)."""
