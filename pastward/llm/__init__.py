"""Operators for preparing training text: deduplication, decontamination, language, quality, tokens, chats and shards."""
