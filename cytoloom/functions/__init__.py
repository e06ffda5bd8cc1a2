"""Statistical tests and draws."""
