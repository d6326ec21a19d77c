"""Writers for manifests, reports, extracts and cursor state."""
