"""Graph operators: superstep dataflow, algorithms, sorting."""
