"""Tables that can be read, and what can be written."""
