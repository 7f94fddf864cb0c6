"""DataFrame to DataFrame operations.  Column names are parameters, so each serves building tables and others alike."""
