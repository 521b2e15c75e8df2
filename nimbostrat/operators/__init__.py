"""Relational operators over forecast fields."""
