"""operators of ammlytics."""
