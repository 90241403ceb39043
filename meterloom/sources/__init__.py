"""Reading logs and event tables, and the partitioned store of records."""
