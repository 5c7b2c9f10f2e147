"""DataFrame-to-DataFrame operators on event logs."""
