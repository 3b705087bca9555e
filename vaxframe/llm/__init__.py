"""Operators for text corpora: quality, pieces, decontamination, personal data, near copies, rules, secrets, hosts, shards, repeats."""
