"""Graphs, plan inspection, and the catalogue of registered queries."""
