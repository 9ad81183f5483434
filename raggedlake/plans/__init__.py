"""Session set-up and helpers that concern whole plans."""
