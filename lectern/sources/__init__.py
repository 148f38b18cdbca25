"""Sources: fixture bundles, paged sheets and snapshot manifests."""
