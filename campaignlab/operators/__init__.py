"""User-level operators (audience extraction, activity check, status update)."""
