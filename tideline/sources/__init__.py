"""Where tables come from and are kept."""
