"""Part of the statuta package; see README."""
