"""Readers and writers for documents, invoices, claims and configuration."""
