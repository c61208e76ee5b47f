"""No stream operator: the planning engine is batch only; see README."""
