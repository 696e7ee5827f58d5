"""Where run events come from and where they are kept."""
