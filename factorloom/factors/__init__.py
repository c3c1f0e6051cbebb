"""Factor families: what they compute and how they are built."""
