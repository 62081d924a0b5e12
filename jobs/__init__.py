"""Runnable jobs: each has a function that takes a session, a command line (python -m jobs.NAME) and a config file of its name."""
