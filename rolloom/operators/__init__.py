"""Relational operators over scores, requests, responses and rounds."""
