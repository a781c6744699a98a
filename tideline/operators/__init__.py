"""Relational building blocks: snapshot diff, merges, fingerprints, statistics, partitions, checksums, comparison."""
