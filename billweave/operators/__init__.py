"""DataFrame-to-DataFrame operators. None runs an action."""
