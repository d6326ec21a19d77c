"""Readers for manifests, datasets, landing zones and logs."""
