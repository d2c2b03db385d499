"""functions of ammlytics."""
