"""Reading landed files and writing stage outputs."""
