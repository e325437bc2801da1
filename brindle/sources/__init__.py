"""Buckets, the change log and backups."""
