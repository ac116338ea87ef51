"""Runnable jobs: each has a command line, a config file, and a run function that takes a session."""
