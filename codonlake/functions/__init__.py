"""See the module docstrings in this folder."""
