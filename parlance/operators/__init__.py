"""Relational operators on segments, turns, sentences and vectors."""
