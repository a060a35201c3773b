"""From statements to plans."""
