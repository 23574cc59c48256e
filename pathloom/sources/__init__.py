"""Tables and texts to spaces."""
