"""Training-data operators on documents; nothing outside this subpackage imports it."""
