"""Functions of the track, flow and sensor library."""
