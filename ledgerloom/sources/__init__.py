"""Readers and writers for record corpora, result ledgers and turn logs."""
