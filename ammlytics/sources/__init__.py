"""sources of ammlytics."""
