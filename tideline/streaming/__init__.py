"""Change streams into a target."""
