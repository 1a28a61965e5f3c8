"""Part of the engine; see the README for the layout."""
