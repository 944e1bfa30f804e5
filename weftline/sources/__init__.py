"""Readers and writers for shards, manifests, result files, logs and checkpoints."""
