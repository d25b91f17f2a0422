"""Analytics of recorded-meeting gaze data on Spark."""
