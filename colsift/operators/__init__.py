"""The table profile, the nine checks and the operators they share."""
