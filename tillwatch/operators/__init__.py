"""DataFrame to DataFrame steps of a tracking run."""
