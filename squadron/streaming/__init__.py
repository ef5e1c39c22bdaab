"""Event streams: a fleet's plans are replanned as its disturbance events come in."""
