"""Operators of a training-data pipeline: sharding, scans, classifiers, fingerprints, packing, deduplication, archives."""
