"""Operators over large text corpora, their queries and, where SQL can say it, their SQL."""
