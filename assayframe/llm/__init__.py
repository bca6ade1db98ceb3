"""Operators for training-data pipelines: rules, fingerprints, packing, tokens, near copies, shards."""
