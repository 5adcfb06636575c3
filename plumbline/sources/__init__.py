"""Where data and metrics come from and go to."""
