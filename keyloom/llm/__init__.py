"""Training-data operators; nothing else in keyloom imports this subpackage."""
