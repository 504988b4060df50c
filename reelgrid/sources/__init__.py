"""Archive reading, validation and loading."""
