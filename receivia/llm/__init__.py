"""Operators for preparing training corpora; each module holds one operator and its query."""
