"""loomgraph: vertex-centric graph analytics expressed as Spark DataFrame plans."""
