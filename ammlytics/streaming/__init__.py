"""streaming of ammlytics."""
