"""Scalar functions: random numbers both engines agree on, collision and stop probabilities, symbols."""
