"""Checks on streams, batch by batch, with mergeable states."""
