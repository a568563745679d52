"""Entity readers, corpora of the driver tables, snapshots and embedders."""
