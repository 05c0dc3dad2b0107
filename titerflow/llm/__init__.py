"""Operators for preparing large training corpora, and their registered queries."""
