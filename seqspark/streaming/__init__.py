"""Micro-batch versions of the batch operators."""
