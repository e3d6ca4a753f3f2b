"""Training-data operators for a text and web corpus. Nothing outside this package imports it."""
