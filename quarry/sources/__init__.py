"""Where points come from: files, generators, scalings and seeds."""
