"""Streams of observations: archives as they land, keyed upserts, alerts."""
