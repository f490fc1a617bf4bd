"""The analyses: each a function from raw or normalised tables to a result DataFrame."""
