"""Runnable jobs over the given tables: each a function of a session, with a command line and a configuration file."""
