"""Operators of a training-data pipeline: filters, deduplication, mixing, tokens, chat. Nothing else imports this package."""
