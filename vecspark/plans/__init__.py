"""Session preparation and plan-shaping helpers shared by the operators."""
