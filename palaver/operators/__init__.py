"""Relational operators on conversations, users and judgements."""
