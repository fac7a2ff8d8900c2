"""The engine's queries over the driver tables, each with its SQL."""
