"""Where data comes from and goes to: the change log and its commits."""
