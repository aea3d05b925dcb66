"""Iteration: vertex programs and the supersteps that run them."""
