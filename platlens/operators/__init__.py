"""Part of the library; see README.md for the operator list."""
