"""Distribution tails and p-value adjustments."""
