"""Query text to plans, and plan explanations."""
