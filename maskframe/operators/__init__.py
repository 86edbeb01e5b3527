"""Operators on masked tables and tensors."""
