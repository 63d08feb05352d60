"""Published outputs."""
