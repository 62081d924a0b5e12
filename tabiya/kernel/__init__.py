"""Chess rules in plain Python, called per batch by the sources and plans."""
