"""Runnable jobs: each is a function of a session and paths, with a command line (`python -m jobs.NAME --help`) and a config file."""
