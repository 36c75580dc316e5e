"""DataFrame-to-DataFrame operators; every lookup takes a DataFrame of requests."""
