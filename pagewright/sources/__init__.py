"""Reading and writing outlines, sections and runs."""
