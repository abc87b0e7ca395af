"""Index tables, snapshots and loaders."""
