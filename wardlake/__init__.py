"""wardlake: bronze -> silver -> gold analytics over emergency-room visits, on Spark."""

__version__ = "0.1.0"
