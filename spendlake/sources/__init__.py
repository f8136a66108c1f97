"""Readers and writers of the billing table, provider payloads and message logs."""
