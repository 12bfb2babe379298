"""Writers for merged records."""
