"""Operators over document tables: key-value, sub-document, full text, indexes, transactions, replication."""
