"""Part of the core library."""
