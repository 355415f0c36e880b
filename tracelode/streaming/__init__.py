"""Live session state over event streams."""
