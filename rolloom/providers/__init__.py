"""Calls to models: the offline provider, live ones with rate limits and retries, and providers of batches."""
