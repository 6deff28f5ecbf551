"""Readers for file listings, headers, images and embedded data, and the sidecar sink."""
