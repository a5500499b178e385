"""DataFrame -> DataFrame operators; every operator takes column names."""
